"""Row numbers hold when a table is split otherwise between two reads, as after executors come or go."""

from pyspark.sql import functions as F

from fathomline.llm import common, mixing, substring, suffixes
from fathomline.functions.staging import staged

SETTING = "spark.sql.files.minPartitionNum"


def six_files(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 7 + i) % 997).cast("string"))))
    return staged(spark.range(1200).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source")).repartition(6))


def test_numbers_do_not_follow_the_splits(spark):
    docs, reads = six_files(spark), []
    for n in (1, 4, 40):
        spark.conf.set(SETTING, n)
        reads.append({r.doc_id: r.row for r in common.rows_numbered(docs, ["doc_id", "text"]).select("doc_id", "row").collect()})
    spark.conf.unset(SETTING)
    assert reads[0] == reads[1] == reads[2] and len(set(reads[0].values())) == 1200 and min(reads[0].values()) >= 0


def test_results_hold_when_splits_move(spark, monkeypatch):
    docs, seen = six_files(spark), {}
    write = common.staged

    def moving(df, name="staged"):                    # every table that is written moves the splits of the reads after it
        out = write(df, name)
        spark.conf.set(SETTING, 1 + (int(spark.conf.get(SETTING, "1")) * 7) % 40)
        return out
    runs = {"op1": lambda: substring.deduplicated(docs), "op10": lambda: suffixes.deduplicated(docs),
            "mix": lambda: mixing.mixed_documents(docs).select("doc_id", "text")}
    for name, run in runs.items():
        seen[name] = sorted(map(tuple, run().collect()))
    for module in (common, mixing, substring, suffixes):
        if hasattr(module, "staged"):
            monkeypatch.setattr(module, "staged", moving)
    for name, run in runs.items():
        assert sorted(map(tuple, run().collect())) == seen[name], name
    spark.conf.unset(SETTING)


def test_a_table_that_is_no_file_is_written_first(spark):
    t = common.rows_numbered(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), ["doc_id", "text"])
    assert t.select("row").distinct().count() == 2 and common.rows_numbered(t.limit(0), ["doc_id"]).count() == 0
    named = staged(spark.range(3).select(F.col("id").alias("_metadata"), F.col("id").alias("row")))
    assert named.select(common.row_of(common.settled(named))).distinct().count() == 3
