"""bench.py's shuffle-byte accounting reads Spark event logs correctly."""

import json
import os

import bench


def test_shuffle_bytes_groups_tasks_by_job_group(tmp_path):
    d = tmp_path / "eventlog_v2_app"
    os.makedirs(d)
    events = [
        {"Event": "SparkListenerJobStart", "Job ID": 1, "Stage IDs": [10, 11],
         "Properties": {"spark.jobGroup.id": "q:a"}},
        {"Event": "SparkListenerJobStart", "Job ID": 2, "Stage IDs": [12],
         "Properties": {"spark.jobGroup.id": "q:b"}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 10,
         "Task Metrics": {"Shuffle Write Metrics": {"Shuffle Bytes Written": 100}}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 11,
         "Task Metrics": {"Shuffle Write Metrics": {"Shuffle Bytes Written": 50}}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 12,
         "Task Metrics": {"Shuffle Write Metrics": {"Shuffle Bytes Written": 7}}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 99, "Task Metrics": {}},
    ]
    (d / "events_1_app").write_text("\n".join(json.dumps(e) for e in events) + "\n")
    (d / "appstatus_app").write_text("")
    assert bench.shuffle_bytes(str(tmp_path)) == {"q:a": 150, "q:b": 7}
