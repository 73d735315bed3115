"""What the query modules share: the graph in SQL, and its frames."""

GRAPH = """
    WITH RECURSIVE code AS (
        SELECT id, label, name, filePath, startLine, endLine, language, isExported, repo
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM parsed_nodes WHERE id IS NOT NULL) WHERE rn = 1),
    nodes AS (
        SELECT id, label, name, filePath, language, isExported, repo FROM code
        UNION ALL SELECT id, label, name, filePath, language, isExported, NULL FROM shared_nodes
        UNION ALL SELECT id, 'Community', label, NULL, NULL, NULL, NULL FROM communities
        UNION ALL SELECT id, 'Process', label, NULL, NULL, NULL, NULL FROM processes),
    edges AS (
        SELECT id, sourceId AS src, targetId AS dst, type, coalesce(confidence, 1.0) AS confidence, coalesce(reason, '') AS reason, coalesce(step, 0) AS step, repo
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM graph_relationships WHERE id IS NOT NULL)
        WHERE rn = 1 AND sourceId IS NOT NULL AND targetId IS NOT NULL)
"""


def graph(sql: str) -> str:
    """SQL over nodes, edges and code; a statement that starts with ',' adds tables of its own."""
    return GRAPH + sql


class Book:
    """Queries of a module with their SQL, registered by decorator."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put
