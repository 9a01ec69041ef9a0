"""Views over a small recording."""

import json
import math

from pyspark.sql import functions as F

from orrery.sources import recordings as R
from orrery.sources.tables import SCHEMAS


def table(spark, name, *rows):
    schema = spark.createDataFrame([], SCHEMAS[name]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def test_views(spark, tmp_path):
    sample = table(spark, "sample", *[{"token": f"s{k}", "timestamp": k * 500_000 + (4_000_000 if k == 3 else 0), "scene_token": "a"} for k in range(4)])
    anns = table(spark, "sample_annotation", *[{"token": f"x{k}", "sample_token": f"s{k}", "instance_token": "i", "translation": [float(k), 2.0 * k, 0.0], "prev": f"x{k - 1}" if k else "", "next": f"x{k + 1}" if k < 3 else ""} for k in range(4)])
    v = {r.token: (r.vx, r.vy) for r in R.box_velocity(anns, sample).collect()}
    assert v["x0"] == (2.0, 4.0) and v["x1"] == (2.0, 4.0) and math.isnan(v["x2"][0]) and math.isnan(v["x3"][0])
    named = R.decorated_annotations(anns, table(spark, "instance", {"token": "i", "category_token": "c"}), table(spark, "category", {"token": "c", "name": "vehicle.car"}))
    assert {r.category_name for r in named.collect()} == {"vehicle.car"}
    data = table(spark, "sample_data", *[{"token": f"d{k}", "sample_token": f"s{k // 2}", "ego_pose_token": "e", "calibrated_sensor_token": "k", "is_key_frame": k % 2 == 0, "timestamp": k} for k in range(6)])
    seen = R.decorated_data(data, table(spark, "calibrated_sensor", {"token": "k", "sensor_token": "z"}), table(spark, "sensor", {"token": "z", "channel": "LIDAR", "modality": "lidar"}))
    full = {r.token: r for r in R.samples_with_contents(sample, seen, anns).collect()}
    assert full["s1"].data == {"LIDAR": "d2"} and full["s1"].anns == ["x1"] and full["s3"].data is None
    assert [r.frame for r in R.frame_index(sample).orderBy("timestamp").collect()] == [0, 1, 2, 3]
    back = {r.token: r.sweeps for r in R.look_back(seen.withColumn("scene_token", F.lit("a")), 3).collect()}
    assert back == {"d0": ["d0"], "d2": ["d0", "d1", "d2"], "d4": ["d2", "d3", "d4"]}
    h = math.radians(90) / 2
    pose = table(spark, "ego_pose", {"token": "e", "translation": [1.0, 0.0, 0.0], "rotation": [math.cos(h), 0.0, 0.0, math.sin(h)]})
    got = {r.token: (round(r.ex, 6), round(r.ey, 6)) for r in R.in_ego_frame(anns, seen.where("is_key_frame"), pose).collect()}
    assert got["x1"] == (2.0, 0.0) and got["x2"] == (4.0, -1.0)
    assert {r.log_token for r in R.log_of_map(table(spark, "map", {"token": "m", "log_tokens": ["l1", "l2"]})).collect()} == {"l1", "l2"}
    scenes = table(spark, "scene", {"token": "a", "name": "one"}, {"token": "b", "name": "two"})
    assert [r.token for r in R.scenes_of_split(scenes, spark.createDataFrame([("val", "two")], "split string, name string"), "val").collect()] == ["b"]
    (tmp_path / "scene-0001_pose.json").write_text(json.dumps([{"Utime": 1, "Speed": 2.5}, {"Utime": 2, "Speed": 3.5}]))
    m = R.read_messages(spark, str(tmp_path / "*.json"), "Utime bigint, Speed double")
    assert sorted((r.scene, r.utime, r.speed) for r in m.collect()) == [("scene-0001", 1, 2.5), ("scene-0001", 2, 3.5)]
    assert R.read_messages(spark, str(tmp_path / "*.json"), "Utime bigint, Speed double", m.select("scene").distinct()).count() == 0
