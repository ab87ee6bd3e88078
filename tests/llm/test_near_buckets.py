"""Members of a bucket outside its largest component are held against all of it."""

from __future__ import annotations

from pagemask.llm import near_copies


def test_both_sides_of_a_bucket_take_the_same_one(spark):
    """Of many buckets with the same members one is worked on: each left member meets each right one, however rows are dealt."""
    members = [(b, n) for b in range(300) for n in (10 * (b % 20), 10 * (b % 20) + 1, 10 * (b % 20) + 2)]
    rows = near_copies._bucketed(spark.createDataFrame(members, "bucket long, node long"))
    found = spark.createDataFrame([(10 * k + 1, 10 * k) for k in range(20)], "node long, root long")
    left, right = {}, {}
    for r in near_copies._rest(rows.repartition(7), found).collect():
        (right if r.right else left).setdefault(r.block, set()).add(r.node)
    assert sorted(map(sorted, left.values())) == [[10 * k + 2] for k in range(20)]
    assert all(right[b] == {n - 2, n - 1, n} for b, ns in left.items() for n in ns)
