"""Pieces of files dealt to a bounded number of tasks."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

from lodestone.llm import deal, huffman, warc

from .test_operators import PATH


@pytest.mark.parametrize("n, most", [(1, 4), (4, 4), (1000, 4), (1000, 50), (0, 4)])
def test_pieces_lie_in_runs_of_about_one_length(spark, tmp_path, monkeypatch, n, most):
    monkeypatch.setattr(deal, "MOST_TASKS", most)
    pieces = spark.range(n).select(F.format_string("f%06d", "id").alias("path"), "id").repartition(3)
    got = deal.dealt(pieces, "path").withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.id for r in got) == list(range(n))
    tasks = collections.defaultdict(list)
    for r in got:
        tasks[r.part].append(r.id)
    assert len(tasks) <= min(n, most)
    for ids in tasks.values():
        assert max(ids) - min(ids) == len(ids) - 1 and len(ids) <= 2 * -(-n // most)


def test_archives_and_id_files_read_by_fewer_tasks(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"http://x/{k}", "word " * (k % 9) + str(k % 20)) for k in range(200)] + [(500, None, None)], "page_id long, url string, html string").repartition(8)
    docs = texts.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    stretches, manifest = warc.write(texts), huffman.write(docs, PATH)
    assert stretches.count() > 2 and manifest.count() > 2
    want = sorted(map(tuple, warc.payloads(warc.read(stretches)).collect()), key=str), sorted(map(tuple, huffman.ids_digest(manifest).collect()))
    monkeypatch.setattr(deal, "MOST_TASKS", 2)
    read = warc.read(stretches), huffman.ids_digest(manifest)
    assert [r.rdd.getNumPartitions() for r in read] == [2, 2]
    assert (sorted(map(tuple, warc.payloads(read[0]).collect()), key=str), sorted(map(tuple, read[1].collect()))) == want
    assert len(want[0]) == len(want[1]) == 201
