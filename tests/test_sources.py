"""Row order on load, workbooks, report versions, sheet checks, merged states."""

import io as io_
import os
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotstats import catalog
from plotstats.functions import aggregates as ag
from plotstats.operators import sites, sizes, stand
from plotstats.plans import nested, report
from plotstats.plans.session import scratch_path
from plotstats.sources import checks, io, rows, workbook
from plotstats.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


# --- row order -----------------------------------------------------------------------


@pytest.fixture
def short_splits(spark):
    """Splits of a few hundred bytes, several of them in one task."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def sheet(n, seed=1):
    """Coordinates lines of n plots in sheet order, a site's plots scattered over the sheet."""
    random.seed(seed)
    return [("I", f"S{random.randrange(9)}", f"P{i}", random.choice(["Basin", "Fringe", "Salt Pond"]), 17.0, -65.0) for i in range(n)]


def first_types(lines):
    out = {}
    for line in lines:
        out.setdefault(line[1], line[3])
    return out


COLUMNS = "Island string, Site string, Plot string, `Forest type` string, Latitude double, Longitude double"


@pytest.mark.parametrize("fmt", io.FORMATS)
def test_rows_are_numbered_in_file_order(spark, tmp_path, short_splits, monkeypatch, fmt):
    monkeypatch.setattr(rows, "BLOCK", 4)  # several blocks of splits
    lines = sheet(300)
    for k in range(3):  # three files, in order of their names
        part = spark.createDataFrame(lines[k * 100:(k + 1) * 100], COLUMNS).coalesce(1)
        w = part.write.option("header", "true")
        getattr(w, fmt)(f"{tmp_path}/part{k}")
    target = tmp_path / "t" / "coordinates"
    target.mkdir(parents=True)
    for k in range(3):
        for f in (tmp_path / f"part{k}").iterdir():
            if f.name.startswith("part-"):
                f.rename(target / f"{k}.{fmt}")
    got = io.load_tables(spark, str(tmp_path / "t"), fmt, ["coordinates"])["coordinates"]
    assert got.rdd.getNumPartitions() > 3 or fmt == "parquet"
    assert sorted((r.Row, r.Plot) for r in got.collect()) == [(i + 1, x[2]) for i, x in enumerate(lines)]
    assert {r.Site: r.Typology for r in sites.site_coordinates(got).collect()} == first_types(lines)


def test_given_row_numbers_stay(spark, tmp_path):
    lines = [(*x, 100 - i) for i, x in enumerate(sheet(20))]
    spark.createDataFrame(lines, COLUMNS + ", Row long").write.json(f"{tmp_path}/coordinates")
    got = io.load_tables(spark, str(tmp_path), "json", ["coordinates"])["coordinates"]
    assert sorted((r.Row, r.Plot) for r in got.collect()) == sorted((x[6], x[2]) for x in lines)
    assert rows.number_rows(rows.with_places(spark.read.json(f"{tmp_path}/coordinates").where("false"), "json")).count() == 0


# --- workbooks -----------------------------------------------------------------------


def book(sheets):
    return workbook.workbook_bytes(sheets)


def cells(content, name, columns):
    return [list(x) for n, cols in workbook.parse_sheet(content, name, columns) for x in zip(n, *cols)]


def test_workbook_round_trip(monkeypatch):
    monkeypatch.setattr(workbook, "BATCH_ROWS", 2)
    odd = ["NA", "a & <b> \"c\"", "  spaces  ", "line\nfeed", "tab\tand \x01 control", "_x0041_ literal", "é漢🙂", ""]
    table = [[i, x, i / 3 if i % 2 else None, bool(i % 2)] for i, x in enumerate(odd)]
    content = book({"Other": (["x"], [[1]]), "Da ta & \"q\"": (["n", "text", "d", "flag"], table)})
    got = cells(content, "Da ta & \"q\"", ["flag", "text", "missing", "d"])
    assert got == [[i + 2, "TRUE" if i % 2 else "FALSE", x, None, repr(i / 3) if i % 2 else None] for i, x in enumerate(odd)]
    assert cells(content, "No such sheet", ["n"]) == []
    assert book({"S": (["a"], [["b"]])}) == book({"S": (["a"], [["b"]])})


def test_cells_of_every_kind(tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {link}><sheets><sheet name="S" sheetId="1" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Type="t" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh sb='0' eb='1'><t>hint</t></rPh></si><si><t>never used</t></si></sst>")
        z.writestr("xl/worksheets/a.xml", f"""<worksheet {main}><sheetData><row r="1"/><row r="3"><c r="B3" t="s"><v>0</v></c><c r="AA3" t="inlineStr"><is><t>Far</t></is></c><c r="AB3" t="str"><v>Name</v></c></row>
            <row r="5"><c r="B5" t="s"><v>1</v></c><c r="AA5"><v>1.50E-2</v></c><c r="AB5"><v>99</v></c></row>
            <row><c/><c t="e"><v>#N/A</v></c></row><row r="9"><c r="B9" t="str"><f>A1</f><v>formula</v></c><c r="AA9" t="b"><v>1</v></c></row><row r="10"></row></sheetData></worksheet>""")
    content = (tmp_path / "b.xlsx").read_bytes()
    assert cells(content, "S", ["Far", "Name"]) == [[5, "1.50E-2", "rich text"], [6, None, None], [9, "TRUE", "formula"]]


def test_plain_rows_need_no_xml_parser(monkeypatch):
    """Rows in the usual form cost a pattern each; the parser reads the header, and on from the first other row."""
    closed, seen = workbook._closed, []

    def counted(book, part, tag):
        for e in closed(book, part, tag):
            seen.append(tag)
            yield e

    columns, table = ["n", "text", "d", "flag"], [[i, f"t{i % 7}", i / 3 if i % 2 else None, bool(i % 2)] for i in range(500)]
    content = book({"S": (columns, table)})
    monkeypatch.setattr(workbook, "_closed", counted)
    monkeypatch.setattr(workbook, "READ_BYTES", 1000)
    plain = cells(content, "S", ["flag", "text", "none", "d"])
    assert plain == [[i + 2, "TRUE" if f else "FALSE", t, None, None if d is None else repr(d)] for i, (_, t, d, f) in enumerate(table)]
    assert seen.count("row") == 1
    monkeypatch.setattr(workbook, "STRING_BYTES", 0)  # strings in use only
    assert cells(content, "S", ["flag", "text", "none", "d"]) == plain

    def changed(old, new, encoding="utf-8"):
        out = io_.BytesIO()
        with zipfile.ZipFile(io_.BytesIO(content)) as a, zipfile.ZipFile(out, "w") as b:
            for part in a.namelist():
                x = a.read(part).decode()
                b.writestr(part, x.replace(old, new).encode(encoding) if part.endswith("sheet1.xml") else x.encode())
        return cells(out.getvalue(), "S", ["flag", "text", "none", "d"])

    row = '<row r="300"><c r="A300"><v>298</v></c>'
    assert changed(row, row.replace("300", "300", 1) + "<!-- <c r=\"C300\"><v>7</v></c> -->") == plain
    assert changed(row, row.replace("298", "&#50;98")) == plain
    assert changed(row, '<row spans="1:4"><c><v>298</v></c>') == plain
    assert changed(row, "<row r='299' hidden='1'/>" + row) == plain
    assert changed(row, row.replace("><c", ' spans="1:4" ht="15.5"><c s="3"', 1).replace('c s="3" r="A300"', 'c r="A300" s="3"')) == plain
    assert changed('encoding="UTF-8"', 'encoding="UTF-16"', "utf-16") == plain
    assert changed('<sheetData>', '<!-- <sheetData><row r="1"><c r="A1"><v>1</v></c></row> --><sheetData>') == plain
    missing = changed('<c r="A300"><v>298</v></c><c r="B300" t="s"', '<c r="A300" s="2"/><c r="B300" t="e"')
    assert missing[298] == [300, "FALSE", None, None, None]
    assert missing[:298] + missing[299:] == plain[:298] + plain[299:]


def test_plain_workbooks_are_read_and_packed_as_arrays(spark, monkeypatch):
    """No step for each row: neither the two patterns nor lists of cells are used, and the bytes stay the same."""
    random.seed(3)
    columns = ["n", "text", "d", "flag", "none", "f"]
    table = [[i, random.choice(["NA", "a & b", "_x0041_", "é漢🙂", None]), random.choice([None, i / 3, -0.0, 0.0, 1e300, 5.0]), bool(i % 2), None, None] for i in range(400)]
    arrays = pa.table({c: pa.array([r[i] for r in table], kind) for i, (c, kind) in enumerate(zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.null(), pa.float32())))})
    assert workbook.table_workbook("S", arrays) == book({"S": (columns, table)})
    assert workbook.table_workbook("S", arrays.slice(0, 0)) == book({"S": (columns, [])})
    df = spark.createDataFrame([r[:4] for r in table], "n long, text string, d double, flag boolean").coalesce(1)
    monkeypatch.setattr(workbook, "workbook_bytes", None)
    monkeypatch.setattr(workbook, "_rows", None)
    monkeypatch.setattr(workbook, "READ_BYTES", 3000)
    packed = sorted(workbook.pack_workbooks(df, "S", "p", 150).collect())
    assert [len(cells(r.content, "S", ["n"])) for r in packed] == [150, 150, 100]
    got = [row for r in packed for row in cells(r.content, "S", columns[:4])]
    assert [g[1:] for g in got] == [[str(n), t, None if d is None else repr(d), "TRUE" if f else "FALSE"] for n, t, d, f, *_ in table]


def odd_sheet(seed):
    """A sheet of random cells, some of them in forms that are rarely seen or wrong, and a workbook around it."""
    random.seed(seed)
    strange = [0, 0, 0.002, 0.02][seed % 4]
    value = lambda: random.choice(["1", "2.50", "x > y", "é漢", " 7 ", "-1E-3", "_x0041_", "12345678901", ""])

    def cell(r, c):
        at = f"{workbook._letters(c)}{r}"
        if random.random() < strange:
            return random.choice([f'<c r="{at}"></c>', f"<c r='{at}'><v>3</v></c>", f'<c r="{at}" t="inlineStr"><is><t>in</t></is></c>', f'<c r="{at}"><f>A1</f><v>4</v></c>', f'<c r="{at}"><v>&lt;&#65;</v></c>',
                                  f'<c r="{at}" t="s" s="1"><v>1</v></c>', f'<c r="{at}"> <v>5</v></c>', "<!-- <c> -->", f'<c r="{at}"><v>a\r\nb</v></c>', f'<c r="{at}"><v>1</v><v>2</v></c>', f'<c r="{at}" t="b"><v> 1 </v></c>'])
        style = random.choice(["", "", ' s="3"', ' s="12"'])
        return random.choice([f'<c r="{at}"{style}><v>{value()}</v></c>', f'<c r="{at}"{style} t="s"><v>{random.randrange(6)}</v></c>', f'<c r="{at}"{style} t="b"><v>{random.randrange(2)}</v></c>',
                              f'<c r="{at}"{style} t="str"><v>{random.choice(["text", "a_b"])}</v></c>', f'<c r="{at}"{style} t="e"><v>#N/A</v></c>', f'<c r="{at}"{style}/>', "", ""])

    lines, r = [], 1
    for _ in range(200):
        r += random.choice([1, 1, 1, 3])
        order = sorted(random.sample(range(34), random.randrange(9)), key=None if random.random() < 0.9 else lambda c: -c)
        order += order[:1] * (random.random() < 0.05)  # a column twice
        tag = random.choice([f'<row r="{r}">', f'<row r="{r}" spans="1:34" ht="15.5" x14ac:dyDescent="0.25">'])
        if random.random() < strange:
            tag = random.choice([f"<row r='{r}'>", "<row>", f'<row spans="1:2" r="{r}">', f'<row r="{r}"  ht="2">'])
        lines.append(tag + "".join(cell(r, c) for c in order) + "</row>" + random.choice(["", "", "\n", "\n  "]))
    header = '<row r="1">' + "".join(f'<c r="{workbook._letters(c)}1" t="str"><v>c{c}</v></c>' for c in range(34)) + "</row>"
    content, out = book({"S": (["a", "b"], [[f"s{i} &amp; <{i}>", None] for i in range(6)])}), io_.BytesIO()
    with zipfile.ZipFile(io_.BytesIO(content)) as a, zipfile.ZipFile(out, "w") as b:
        for part in a.namelist():
            x = a.read(part).decode()
            if part.endswith("sheet1.xml"):
                x = x[:x.index("<sheetData>") + 11] + header + "".join(lines) + "</sheetData><mergeCells/></worksheet>"
                x = x.replace("<worksheet ", '<worksheet xmlns:x14ac="http://schemas.microsoft.com/office/spreadsheetml/2009/9/ac" ')
            b.writestr(part, x)
    return out.getvalue()


@pytest.mark.parametrize("read_bytes", [500, 1 << 19])
def test_arrays_equal_the_xml_parser_on_odd_sheets(monkeypatch, read_bytes):
    columns = [f"c{c}" for c in range(34)]
    found = []
    for seed in range(24):
        content = odd_sheet(seed)
        with monkeypatch.context() as m:
            m.setattr(workbook, "READ_BYTES", read_bytes)
            got = cells(content, "S", columns)
        with monkeypatch.context() as m:  # the XML parser alone
            for name in ("plain_blocks", "plain_rows"):
                m.setattr(workbook, name, lambda *_: iter(()))
            m.setattr(workbook, "plain_strings", lambda _: None)
            assert got == cells(content, "S", columns), seed
        found.append(len(got))
    assert min(found) > 50


def test_workbook_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    """The rows of one input part are packed by many tasks, and every workbook is a file of its own."""
    written = []
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    pack = workbook.pack_workbooks
    monkeypatch.setattr(workbook, "pack_workbooks", lambda df, sheet, prefix: written.append((prefix, df)) or pack(df, sheet, prefix, 500))
    catalog.QUERIES["workbook_scan"](spark, SF)
    books = spark.read.parquet(f"{tmp_path}/workbooks/books")
    files = [f for f in os.listdir(tmp_path / "workbooks/books") if f.endswith(".parquet")]
    assert books.count() > 9 and len(files) >= books.count()
    assert all("Exchange hashpartitioning(SY" in df._jdf.queryExecution().toString() for n, df in written if n != "coordinates")


def test_folder_of_workbooks_equals_csv(spark, tmp_path):
    names = ["trees", "densiometer", "coordinates"]
    tables = {n: io.conform(fx.BUILDERS[n](spark, SF), n) for n in names}
    tables["coordinates"] = tables["coordinates"].orderBy("Row").coalesce(1).drop("Row")
    (tmp_path / "books").mkdir()
    for n, df in tables.items():
        io.write_table(df, f"{tmp_path}/csv/{n}", "csv")
        for r in workbook.pack_workbooks(df, workbook.SHEETS[n], n, rows_per_book=700).collect():
            (tmp_path / "books" / r.path).write_bytes(r.content)
    assert len(os.listdir(tmp_path / "books")) > 9
    a, b = io.load_workbooks(spark, str(tmp_path / "books"), names), io.load_tables(spark, str(tmp_path / "csv"), "csv", names)
    for n in names:
        assert a[n].schema == b[n].schema
        x, y = a[n], b[n].select(a[n].columns)
        assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty(), n


def test_workbook_without_a_column_is_refused(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book({"YSI Water Quality data": (["SY", "Site"], [[2022, "S"]])}))
    with pytest.raises(ValueError, match="lacks"):
        io.load_workbooks(spark, str(tmp_path), ["ysi"])


# --- report versions -----------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark):
    root = scratch_path(spark, "versions-survey")
    io.write_survey_tables(fx.survey_tables(spark, SF), root)
    return io.load_tables(spark, root)


def test_a_failed_report_leaves_the_old_version(spark, stored, monkeypatch):
    out = scratch_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        report.read_report(spark, out)
    options = {"bin_size": fx.SIZE_BIN, "island_levels": fx.ISLANDS}
    assert report.publish_report(spark, stored, out, "first", **options) == "first"
    before = {n: df.count() for n, df in report.read_report(spark, out).items()}
    assert len(before) == 12 and before["tree_summary"] == 70

    # the second version holds one site only; one of its writes fails
    some = {n: df.where("Site = 'NATION_8'") for n, df in stored.items()}
    write, written = io.write_table, []

    def failing(df, path, *rest, **more):
        if path.endswith("canopy_cover_series"):
            raise OSError("no space left")
        written.append(path)
        return write(df, path, *rest, **more)

    monkeypatch.setattr(io, "write_table", failing)
    with pytest.raises(OSError):
        report.publish_report(spark, some, out, "second", **options)
    assert report.published_versions(spark, out) == [(1, "first")]
    assert {n: df.count() for n, df in report.read_report(spark, out).items()} == before

    # the retry writes only what is not there
    first_attempt, written[:] = set(written), []
    monkeypatch.setattr(io, "write_table", lambda df, path, *rest, **more: (written.append(path), write(df, path, *rest, **more))[1])
    report.publish_report(spark, some, out, "second", **options)
    assert first_attempt and not set(written) & first_attempt and any(p.endswith("canopy_cover_series") for p in written)
    assert report.published_versions(spark, out) == [(1, "first"), (2, "second")]
    now = report.read_report(spark, out)
    assert {r.Site for r in now["tree_summary"].select("Site").distinct().collect()} == {"NATION_8"}
    assert now["size_freq_all"].schema == report.read_report(spark, out, "first")["size_freq_all"].schema

    # a published name is not written again; old versions can go
    written.clear()
    report.publish_report(spark, stored, out, "second", **options)
    assert not written
    assert report.drop_versions(spark, out, keep=1) == ["first"] and report.published_versions(spark, out) == [(2, "second")]
    with pytest.raises(ValueError):
        report.publish_report(spark, stored, out, "a/b", **options)


# --- checks --------------------------------------------------------------------------


@pytest.fixture
def raw(spark):
    lines = [("2022", "I", "A", "p", "1", "RHMA", "Alive", "1.5"), ("x", "I", "A", "p", "1", "RHMA", "NA", "NA"),
             (None, None, "A", "p", "2", None, None, None), ("2022", "J", "A", "p", "1", "NA", "Alive", "3 cm")]
    return spark.createDataFrame(lines, "SY string, Island string, Site string, Plot string, Quadrat string, Species string, Mortality string, DBH_cm string")


def test_rejected_cells_are_counted_in_the_loading_scan(spark, raw):
    got = {r.column_name: (r.n_cells, r.n_empty, r.n_rejected, r.example) for r in checks.coercion_counts(raw, "trees").collect()}
    assert got == {"SY": (4, 1, 1, "x"), "Quadrat": (4, 0, 0, None), "DBH_cm": (4, 1, 2, "3 cm")}
    plan = checks.coercion_counts(raw, "trees")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    typed, seen = checks.observed(raw, "trees")
    assert typed.schema == io.SURVEY_SCHEMAS["trees"] and typed.count() == 4
    assert seen.get == {"SY": 1, "Quadrat": 0, "DBH_cm": 2}
    assert sorted((r.Site, r.column_name, r.cell) for r in checks.rejected_cells(raw, "trees").collect()) == [
        ("A", "DBH_cm", "3 cm"), ("A", "DBH_cm", "NA"), ("A", "SY", "x")]
    assert checks.coercion_counts(raw.where("false"), "trees").where("n_cells = 0").count() == 3


def test_key_profile_and_unfiled_keys(spark, raw):
    got = {r.key_columns: (r.n_keys, r.n_repeated, r.max_rows, r.n_null) for r in checks.key_profile(raw, "trees").collect()}
    assert got == {"SY, Site, Plot, Quadrat": (3, 1, 2, 1), "SY, Site, Plot": (3, 1, 2, 1), "Site, Plot": (1, 1, 4, 0), "Island, Site": (3, 1, 2, 1)}
    coords = spark.createDataFrame([("I", "A", "q"), (None, "A", None)], "Island string, Site string, Plot string")
    found = {r.key_columns: (r.n_keys, r.n_unfiled) for r in checks.unfiled_keys({"trees": raw}, coords).collect()}
    assert found == {"Site, Plot": (1, 1), "Island, Site": (3, 1)}


# --- merged states, sizes ------------------------------------------------------------


def test_merged_states_equal_recomputed_ones(spark):
    random.seed(5)
    values = [(random.choice("ab"), random.randrange(40), random.choice([None, 1e3 + random.random(), 7.0])) for _ in range(3000)]
    values += [("one", 0, 4.0), ("none", 0, None), ("same", 0, 5.0), ("same", 1, 5.0)]
    df = spark.createDataFrame(values, "s string, p int, v double")
    merged = df.groupBy("s", "p").agg(*ag.moment_state("v", "v")).groupBy("s").agg(*ag.merge_states("v"))
    got = {r.s: (r.v_n, r.se, r.strict) for r in merged.select("s", "v_n", ag.state_error("v").alias("se"), ag.state_error("v", False).alias("strict")).collect()}
    direct = df.groupBy("s").agg(F.count("v").alias("n"), ag.standard_error("v").alias("se"), ag.standard_error("v", na_rm=False).alias("strict"))
    for r in direct.collect():
        n, se, strict = got[r.s]
        assert n == r.n and (strict is None) == (r.strict is None)
        assert se == r.se or se == pytest.approx(r.se, rel=1e-9, abs=1e-12)


def test_sizes_meet_their_site_before_the_first_shuffle(spark, monkeypatch):
    trees = fx.plot_readings(spark, SF, "trees")
    few = sizes.size_freq_all(trees, 3.0)
    monkeypatch.setattr(nested, "BROADCAST_PLOTS", 0)  # too many plots: counts per plot first
    many = sizes.size_freq_all(trees, 3.0)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Plot" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_diameter_error_of_plots_equals_that_of_rows(spark):
    a = {(r.SY, r.Site): r for r in stand.diameter_error(fx.plot_readings(spark, SF, "trees")).collect()}
    for r in stand.diameter_error(fx.trees(spark, SF)).collect():
        assert a[r.SY, r.Site].n_dbh == r.n_dbh and a[r.SY, r.Site].se_dbh == pytest.approx(r.se_dbh, rel=1e-9)
