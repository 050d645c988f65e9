"""What a step writes, shuffles and repeats stays small beside its input."""

import glob
import gzip
import os

from pyspark.sql import functions as F

from trackspark.operators.tracking import LiveTracks
from trackspark.plans.catalog.labels import label_files
from trackspark.plans.views import Views
from trackspark.scale import extent_of, interval_join
from trackspark.session import cut_lineage


def test_label_files_are_written_compressed(spark):
    files = glob.glob(f"{label_files(Views(spark, '/root/testdata/sf0.001'))}/doc=*/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    texts = [gzip.open(f, "rt").read() for f in files]
    assert all(t.startswith("<annotations>") and t.rstrip().endswith("</annotations>") for t in texts)
    assert sum(os.path.getsize(f) for f in files) * 5 < sum(map(len, texts))


def test_stage_tables_are_written_compressed(spark):
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    table = cut_lineage(rows)
    assert all(f.endswith(".zstd.parquet") for f in table.inputFiles()) and table.count() == 20_000


def test_jobs_read_written_views(spark):
    v = Views(spark, "/root/testdata/sf0.001").written("obs")
    assert all("/stage-" in f for f in v.obs.inputFiles()) and v.frames.inputFiles()[0].endswith("/orders.parquet")
    assert v.obs.exceptAll(Views(spark, v.sf_dir).obs).isEmpty() and v.obs.count() == Views(spark, v.sf_dir).obs.count()


def test_only_a_shared_detection_makes_order_matter():
    """Equal overlaps of two tracks with two detections decide nothing; with one detection they do, also if not neighbours."""
    live = lambda *boxes: LiveTracks(30, 0.2, [(1, d, *b) for d, b in enumerate(boxes)])
    box = lambda x: (x, 0.0, x + 10, 10.0)
    apart = live(box(0.0), box(50.0))
    assert apart.step(2, [0, 1], [box(1.0), box(51.0)]) == [0, 1] and not apart.tied
    between = live(box(0.0), box(50.0), box(4.0))
    assert between.step(2, [0, 1], [box(2.0), box(54.0)])[0] == 0 and between.tied


def test_a_range_join_with_a_known_extent_reads_its_points_once(spark):
    points = spark.range(40).select(F.lit("a").alias("k"), "id")
    spans = spark.createDataFrame([("a", 3, 9), ("a", 20, None)], "k string, s bigint, e bigint")
    plain = interval_join(points, spans, ["k"], "id", "s", "e", 4)
    known = interval_join(points, spans, ["k"], "id", "s", "e", 4, extent=extent_of(points, ["k"], "id"))
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, plain.collect())) and known.count() == 26
    ranges = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 40")
    assert ranges(known) == 1 < ranges(plain)


def test_wide_plans_are_compiled(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
