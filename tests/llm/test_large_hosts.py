"""Boilerplate on a host that holds a third of the rows."""

from pyspark.sql import functions as F

from ampflow.llm import lines


def test_a_large_host_does_not_get_off(spark):
    own = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}"), F.col("id")) for k in range(25)])
    host = F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 16))
    # in 35 of the hot host's 4000 documents (0.9 %) and 35 of another's 500; a chance repeat in 20 of the hot one
    banner = ((F.col("id") < 35) | (F.col("id") >= 4000) & (F.col("id") % 16 == 0) & (F.col("id") < 4560)).cast("int")
    text = F.when(banner == 1, F.concat(F.lit("the same banner here\n"), own)).when(F.col("id").between(100, 119), F.concat(F.lit("chance\n"), own)).otherwise(own)
    docs = spark.range(12000).select(F.col("id").alias("doc_id"), host.alias("source"), text.alias("text"))
    got = {r.doc_id: r.removed_words for r in lines.rules(docs, many=30).where("removed_words > 0").select("doc_id", "removed_words").collect()}
    assert set(got) == {*range(35), *range(4000, 4560, 16)} and set(got.values()) == {4}
    clean = {r.doc_id: r.text for r in lines.without_boilerplate(docs.where("doc_id < 4000"), many=30).collect()}
    assert clean[0].startswith("w00 ") and clean[100].startswith("chance")


def test_the_default_limit_binds_in_a_large_host(spark):
    counted = spark.range(1100).select(F.lit("=hot").alias("host"), F.lit(7).cast("long").alias("hash"))
    rows = spark.range(200_000).select(F.lit("=hot").alias("host"))
    assert lines.boilerplate(counted, rows).count() == 1  # 0.55 %
    assert lines.boilerplate(counted.limit(900), rows).count() == 0
