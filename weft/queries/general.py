"""Skewed keys and orphan references over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators.orphans import parents, references, replay
from weft.operators.skew import connections, heavy_keys, joined_aggregates
from weft.plans.graphview import nodes
from weft.sources.tables import table

#: Share of all rows from which a key counts as heavy.
HEAVY = 0.02
#: Ends of the replayed periods.
CUTS = ["2025-04-01", "2025-07-01"]


def _heavy(spark, sf):
    records = table(spark, sf, "parsed_nodes").select("id")
    for t in ("shared_nodes", "communities", "processes"):
        records = records.unionByName(table(spark, sf, t).select("id"))
    return heavy_keys(table(spark, sf, "graph_relationships"), "targetId", HEAVY, records)


def p2_found(spark, sf):
    return _heavy(spark, sf).select("targetId")


def p2_heavy(spark, sf):
    """The heavy targets with their rows, the node rows of their id, and the pairs of the two."""
    return _heavy(spark, sf)


def p2_connections(spark, sf):
    return connections(table(spark, sf, "graph_relationships"), nodes(spark, sf))


def p2_by_label(spark, sf):
    """Relationship rows per repository and label of the target's node rows, with the sum of their confidence."""
    rel = table(spark, sf, "graph_relationships").select("targetId", "confidence")
    exact = F.coalesce(F.col("confidence"), F.lit(0.0)).cast("decimal(18,4)")
    out = joined_aggregates(rel, table(spark, sf, "parsed_nodes").select("id", "repo", "label"), "targetId", "id", ["repo", "label"], {"confidence": exact})
    return out.select("repo", "label", F.col("pairs").cast("long").alias("pairs"), F.col("confidence").cast("double").alias("confidence"))


def _states(spark, sf, cuts=CUTS):
    refs = references(table(spark, sf, "graph_relationships"))
    fixed = [table(spark, sf, t).select("id") for t in ("shared_nodes", "communities", "processes")]
    return replay(refs, parents(table(spark, sf, "parsed_nodes"), fixed, table(spark, sf, "node_deletions")), cuts)


def p6_found(spark, sf):
    return _states(spark, sf)[-1][1].pending.select("id", "ref_end").distinct()


def p6_counts(spark, sf):
    """Orphan references per referenced table and month of observedAt; repeated rows of an id count once."""
    p = _states(spark, sf)[-1][1].pending.groupBy("id", "ref_end", "ref_table").agg(F.min("month").alias("month"))
    return p.groupBy("ref_table", "month").agg(F.count("*").alias("orphans"))


def p6_snapshots(spark, sf):
    """Orphan references per table after each period, as they stood then."""
    out = None
    for at, s in _states(spark, sf):
        d = s.pending.select("id", "ref_end", "ref_table").distinct().groupBy("ref_table").agg(F.count("*").alias("orphans")).select(F.lit(at).alias("snapshot"), "ref_table", "orphans")
        out = d if out is None else out.unionByName(d)
    return out


QUERIES = {f.__name__: f for f in (p2_found, p2_heavy, p2_connections, p2_by_label, p6_found, p6_counts, p6_snapshots)}

_ORPHANS = """
    WITH last AS (SELECT id, max(indexedAt) AS arrived FROM parsed_nodes GROUP BY id),
    gone AS (SELECT nodeId AS id, max(deletedAt) AS deleted FROM node_deletions GROUP BY nodeId),
    fixed AS (SELECT id FROM shared_nodes UNION SELECT id FROM communities UNION SELECT id FROM processes),
    ends AS (
        SELECT id, 'source' AS ref_end, sourceId AS key, observedAt, reason FROM graph_relationships WHERE sourceId IS NOT NULL
        UNION ALL SELECT id, 'target', targetId, observedAt, reason FROM graph_relationships WHERE targetId IS NOT NULL),
    orphans AS (
        SELECT e.*, CASE WHEN e.key LIKE 'comm\\_%' ESCAPE '\\' THEN 'communities' WHEN e.key LIKE 'proc\\_%' ESCAPE '\\' THEN 'processes'
            WHEN reason = 'leiden-algorithm' AND NOT contains(e.key, ':') THEN 'communities' WHEN reason = 'trace-detection' AND NOT contains(e.key, ':') THEN 'processes'
            WHEN regexp_matches(e.key, '^[A-Za-z]+:shared/') THEN 'shared_nodes' ELSE 'parsed_nodes' END AS ref_table
        FROM ends e LEFT JOIN last l ON l.id = e.key LEFT JOIN gone g ON g.id = e.key LEFT JOIN fixed f ON f.id = e.key
        WHERE (l.id IS NULL AND f.id IS NULL) OR (l.id IS NOT NULL AND g.deleted > l.arrived))
"""

SQL = {
    "p2_found": "SELECT targetId FROM graph_relationships WHERE targetId IS NOT NULL GROUP BY targetId HAVING count(*) >= 0.02 * (SELECT count(*) FROM graph_relationships)",
    "p2_heavy": """
        WITH t AS (SELECT targetId, count(*) AS n FROM graph_relationships WHERE targetId IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM graph_relationships)),
        r AS (SELECT id, count(*) AS records FROM (SELECT id FROM parsed_nodes UNION ALL SELECT id FROM shared_nodes UNION ALL SELECT id FROM communities UNION ALL SELECT id FROM processes) GROUP BY 1)
        SELECT targetId, n, coalesce(records, 0)::BIGINT AS records, (n * coalesce(records, 0))::BIGINT AS pairs FROM t LEFT JOIN r ON r.id = t.targetId""",
    "p6_snapshots": """
        WITH cuts AS (SELECT * FROM (VALUES ('2025-04-01', TIMESTAMP '2025-04-01'), ('2025-07-01', TIMESTAMP '2025-07-01'), ('end', TIMESTAMP '9999-01-01')) c(snapshot, upto)),
        ends AS (
            SELECT id, 'source' AS ref_end, sourceId AS key, ingestedAt, reason FROM graph_relationships WHERE sourceId IS NOT NULL
            UNION ALL SELECT id, 'target', targetId, ingestedAt, reason FROM graph_relationships WHERE targetId IS NOT NULL),
        last AS (SELECT c.snapshot, n.id, max(indexedAt) AS arrived FROM parsed_nodes n JOIN cuts c ON n.indexedAt < c.upto OR n.indexedAt IS NULL GROUP BY 1, 2),
        gone AS (SELECT c.snapshot, nodeId AS id, max(deletedAt) AS deleted FROM node_deletions n JOIN cuts c ON n.deletedAt < c.upto OR n.deletedAt IS NULL GROUP BY 1, 2),
        fixed AS (SELECT id FROM shared_nodes UNION SELECT id FROM communities UNION SELECT id FROM processes),
        orphans AS (
            SELECT DISTINCT c.snapshot, e.id, e.ref_end, CASE WHEN e.key LIKE 'comm\\_%' ESCAPE '\\' THEN 'communities' WHEN e.key LIKE 'proc\\_%' ESCAPE '\\' THEN 'processes'
                WHEN reason = 'leiden-algorithm' AND NOT contains(e.key, ':') THEN 'communities' WHEN reason = 'trace-detection' AND NOT contains(e.key, ':') THEN 'processes'
                WHEN regexp_matches(e.key, '^[A-Za-z]+:shared/') THEN 'shared_nodes' ELSE 'parsed_nodes' END AS ref_table
            FROM cuts c JOIN ends e ON e.ingestedAt < c.upto OR e.ingestedAt IS NULL
            LEFT JOIN last l ON l.id = e.key AND l.snapshot = c.snapshot LEFT JOIN gone g ON g.id = e.key AND g.snapshot = c.snapshot LEFT JOIN fixed f ON f.id = e.key
            WHERE (l.arrived IS NULL AND f.id IS NULL) OR (l.arrived IS NOT NULL AND g.deleted > l.arrived))
        SELECT snapshot, ref_table, count(*) AS orphans FROM orphans GROUP BY 1, 2""",
    "p2_connections": """
        WITH ids AS (SELECT id FROM parsed_nodes UNION SELECT id FROM shared_nodes UNION SELECT id FROM communities UNION SELECT id FROM processes),
        i AS (SELECT targetId AS id, count(*) AS n FROM graph_relationships GROUP BY 1), o AS (SELECT sourceId AS id, count(*) AS n FROM graph_relationships GROUP BY 1)
        SELECT ids.id, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) + coalesce(o.n, 0) AS connections
        FROM ids LEFT JOIN i ON i.id = ids.id LEFT JOIN o ON o.id = ids.id WHERE ids.id IS NOT NULL""",
    "p2_by_label": """
        SELECT n.repo, n.label, count(*) AS pairs, CAST(sum(CAST(coalesce(r.confidence, 0) AS DECIMAL(18,4))) AS DOUBLE) AS confidence
        FROM graph_relationships r JOIN parsed_nodes n ON n.id = r.targetId GROUP BY n.repo, n.label""",
    "p6_found": _ORPHANS + "SELECT DISTINCT id, ref_end FROM orphans",
    "p6_counts": _ORPHANS + ", one AS (SELECT id, ref_end, ref_table, min(strftime(observedAt, '%Y-%m')) AS month FROM orphans GROUP BY 1, 2, 3) SELECT ref_table, month, count(*) AS orphans FROM one GROUP BY 1, 2",
}
