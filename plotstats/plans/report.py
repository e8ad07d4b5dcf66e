"""The batch report: every result table of a survey written under one folder.

Two stages, each a set of independent write jobs:

1. statistics computed from the survey tables (tree summary, canopy cover,
   seedling / sapling density and tables, water quality, size frequencies);
2. report tables derived from the *written* statistics (tree summary text,
   canopy table and series, water-quality text).

Stage 2 reads stage 1 back from storage instead of recomputing it: the
written tables cut the lineage (a lost executor re-runs only its own
stage's tasks, never the scans and joins behind them) and the statistics
are computed once however many report tables use them.  Callers should
pass survey tables that are themselves read from storage (``io.load_tables``)
so that stage 1 starts from a written table too.

``publish_report`` makes the tables one version:

``<out>/versions/<version>/<result>``  the tables, written in any order and retried at will
``<out>/manifests/<number>-<version>`` written last and moved into place as a whole: for each result
                                       its folder, format and schema

Readers go by the newest manifest, so they see the whole of a version or the one before it.  A
failed write leaves tables that no manifest names; the next attempt at the same version keeps those that
were completed (they carry Spark's ``_SUCCESS``) and writes the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plotstats.functions.expr import DEFAULT_ISLANDS
from plotstats.operators import canopy, regen, sizes, stand, water
from plotstats.plans.session import child_names, move_folder, path_exists, remove_folder
from plotstats.sources import io

# result → partition columns (size frequencies: one folder per site, the
# per-site report files of the survey).
PARTITIONS = {"size_freq_all": ["Site"]}
# results written in row order (the only global sorts, at the sink)
SORTED = {"sapling_table": ["Site", "SY"], "seedling_table": ["Site", "SY"]}


def statistics(tables: Mapping[str, DataFrame], bin_size: float = 3.0,
               island_levels: Sequence[str] = DEFAULT_ISLANDS) -> dict[str, DataFrame]:
    t = tables
    return {
        "tree_summary": stand.tree_summary(t["trees"], t["heights"]),
        "canopy_cover": canopy.canopy_cover(t["densiometer"]),
        "seedling_density": regen.seedling_density(t["regeneration"], t["densiometer"], island_levels),
        "seedling_table": regen.seedling_table(t["regeneration"]),
        "sapling_density": regen.sapling_density(t["regeneration"], t["saplings"], t["densiometer"],
                                                 None, island_levels),
        "sapling_table": regen.sapling_table(t["regeneration"]),
        "mean_water_quality": water.mean_water_quality(t["ysi"]),
        "size_freq_all": sizes.size_freq_all(t["trees"], bin_size),
    }


def report_tables(stats: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "tree_summary_display": stand.tree_summary_display(stats["tree_summary"]),
        "canopy_cover_table": canopy.cover_table(stats["canopy_cover"]),
        "canopy_cover_series": canopy.cover_series(stats["canopy_cover"]),
        "water_quality_table": water.water_table(stats["mean_water_quality"]),
    }


def _ordered(stats: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: df.orderBy(*SORTED[n]) if n in SORTED else df for n, df in stats.items()}


def export_report(spark: SparkSession, tables: Mapping[str, DataFrame], out_dir: str,
                  fmt: str = "parquet", bin_size: float = 3.0,
                  island_levels: Sequence[str] = DEFAULT_ISLANDS) -> dict[str, DataFrame]:
    """Write all result tables to ``<out_dir>/<name>``; returns name → the written
    table, read with the schema it was written in."""
    stats = statistics(tables, bin_size, island_levels)
    schemas = {n: df.schema for n, df in stats.items()}
    written = io.read_results(spark, io.export_results(_ordered(stats), out_dir, fmt, PARTITIONS), fmt, schemas)
    tables_ = report_tables(written)
    schemas = {n: df.schema for n, df in tables_.items()}
    return written | io.read_results(spark, io.export_results(tables_, out_dir, fmt, PARTITIONS), fmt, schemas)


# --- versions ---------------------------------------------------------------------

MANIFEST = "version string, number long, result string, path string, format string, schema string"


def published_versions(spark: SparkSession, out_dir: str) -> list[tuple[int, str]]:
    """(number, version) of the published versions, the newest last."""
    names = [n.partition("-") for n in child_names(spark, f"{out_dir.rstrip('/')}/manifests")]
    return sorted((int(number), version) for number, _, version in names)


def publish_report(spark: SparkSession, tables: Mapping[str, DataFrame], out_dir: str, version: str | None = None,
                   fmt: str = "parquet", bin_size: float = 3.0,
                   island_levels: Sequence[str] = DEFAULT_ISLANDS) -> str:
    """Write all result tables as one version and publish it; returns the version's name.

    A name stands for one state of the survey tables: publishing it again does nothing, and after a failure
    the tables already completed under it are kept.  Without a name a new one is made."""
    out_dir, version = out_dir.rstrip("/"), version or uuid.uuid4().hex[:12]
    if not version or set(version) & set("/\\"):
        raise ValueError(f"not a version name: {version!r}")
    if version in [v for _, v in published_versions(spark, out_dir)]:
        return version
    folder = f"{out_dir}/versions/{version}"

    def staged(frames: Mapping[str, DataFrame], schemas: Mapping[str, StructType]) -> dict[str, DataFrame]:
        """The tables of one stage, written unless they are complete already, read back."""
        paths = {n: f"{folder}/{n}" for n in frames}
        todo = {n: df for n, df in frames.items() if not path_exists(spark, f"{paths[n]}/_SUCCESS")}
        io.export_results(todo, folder, fmt, PARTITIONS, mode="overwrite")
        return io.read_results(spark, paths, fmt, schemas)

    stats = statistics(tables, bin_size, island_levels)
    schemas = {n: df.schema for n, df in stats.items()}
    written = staged(_ordered(stats), schemas)
    derived = report_tables(written)
    derived_schemas = {n: df.schema for n, df in derived.items()}
    staged(derived, derived_schemas)

    number = max((n for n, _ in published_versions(spark, out_dir)), default=0) + 1
    lines = [(version, number, n, f"versions/{version}/{n}", fmt, schema.json()) for n, schema in (schemas | derived_schemas).items()]
    draft = f"{out_dir}/drafts/{uuid.uuid4().hex}"
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.json(draft)
    move_folder(spark, draft, f"{out_dir}/manifests/{number:09d}-{version}")
    return version


def read_report(spark: SparkSession, out_dir: str, version: str | None = None) -> dict[str, DataFrame]:
    """The result tables of a published version, by default the newest."""
    out_dir = out_dir.rstrip("/")
    known = [x for x in published_versions(spark, out_dir) if version in (None, x[1])]
    if not known:
        raise FileNotFoundError(f"{out_dir} has no published version" + (f" {version!r}" if version else ""))
    number, name = known[-1]
    manifest = spark.read.schema(MANIFEST).json(f"{out_dir}/manifests/{number:09d}-{name}")
    # a line for each result table
    lines = manifest.agg(F.sort_array(F.collect_list(F.struct("result", "path", "format", "schema")))).first()[0]
    out = {}
    for line in lines:
        schema = StructType.fromJson(json.loads(line["schema"]))
        out |= io.read_results(spark, {line["result"]: f"{out_dir}/{line['path']}"}, line["format"], {line["result"]: schema})
    return out


def drop_versions(spark: SparkSession, out_dir: str, keep: int = 2) -> list[str]:
    """Remove all published versions but the ``keep`` newest, each manifest before its tables."""
    out_dir = out_dir.rstrip("/")
    old = published_versions(spark, out_dir)[:-keep] if keep > 0 else []
    for number, version in old:
        remove_folder(spark, f"{out_dir}/manifests/{number:09d}-{version}")
        remove_folder(spark, f"{out_dir}/versions/{version}")
    return [version for _, version in old]
