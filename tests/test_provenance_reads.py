"""Provenance reads its edges once, however many hops it walks."""

from engram.operators import graph as G


def test_edges_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1, "SUPERSEDES") for i in range(5)], "source_id long, target_id long, edge_type string")
    starts = spark.createDataFrame([(0,)], "start long")
    chain, summary = G.provenance(edges.mapInArrow(count, edges.schema), starts, 4)
    assert sorted((r.node, r.depth) for r in chain.collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert seen.value == 5
