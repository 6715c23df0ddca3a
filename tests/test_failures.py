from stradale.operators.failures import first_reroutable_edge


def test_edges_after_the_tenth(spark):
    """The first eleven candidates carry no path; the edges of the ring do."""
    n = 12
    ring = [(min(k, (k + 1) % n), max(k, (k + 1) % n), 1.0) for k in range(n)]
    unused = [(k, k + 6 if k < 6 else k + 2 - 6, 1000.0 + k) for k in range(6)] + [(k, k + 3, 2000.0 + k) for k in range(6)]
    nodes = spark.createDataFrame([(k,) for k in range(n)], "node_id long")
    edges = spark.createDataFrame(ring + unused, "src long, dst long, length_m double")
    bc = spark.createDataFrame([(u, v, 1.0 if w > 1 else 0.5) for u, v, w in ring + unused], "src long, dst long, bc double")
    got = first_reroutable_edge(nodes, edges, bc).first()
    assert (got.src, got.dst, got.bc) == (10, 11, 0.5) and got.rerouted > 0 and got.max_increase_m > 0
    assert first_reroutable_edge(nodes, edges.where("length_m < 1").limit(0), bc.limit(0)).count() == 0
