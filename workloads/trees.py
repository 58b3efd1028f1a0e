"""Node tables, JSON documents, reference graphs."""

from pyspark.sql import functions as F

from fieldscope.functions.text import variable_names as names_of
from fieldscope.operators import documents as D
from fieldscope.operators import graph as G
from fieldscope.operators import trees as T
from fieldscope.plans.spread import spread
from workloads import views as V
from workloads.registry import query

# Every node with the ids and keys on its way from the root.
PLACED = """
placed AS (
  SELECT id, [id] AS ids, [key] AS path, 0 AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT n.id, list_append(p.ids, n.id), list_append(p.path, n.key), p.depth + 1
  FROM nodes n JOIN placed p ON n.parent_id = p.id)"""


def label(k):
    return f"""CASE WHEN regexp_matches({k}, '^[_A-Za-z][_A-Za-z0-9]*$') THEN {k} ELSE '["' || {k} || '"]' END"""


@query(
    "tree_flatten",
    f"""WITH RECURSIVE {PLACED}
    SELECT ids[1] AS doc_id, id, depth::INTEGER AS depth, array_to_string(path, '/') AS path, kind, value,
      row_number() OVER (PARTITION BY ids[1] ORDER BY path, id) AS position,
      false AS truncated
    FROM placed JOIN nodes USING (id)""",
    ("nodes",),
)
def tree_flatten(spark, d):
    return T.tree_flatten(V.nodes(spark, d)).select(
        "doc_id", "id", "depth", F.array_join("path", "/").alias("path"), "kind", "value", "position", "truncated"
    )


def placed(spark, d):
    return T.ancestry(V.nodes(spark, d)).withColumn("doc_id", F.col("chain")[0]["id"]).withColumn("path", T.key_path())


@query(
    "tree_path",
    f"""WITH RECURSIVE {PLACED}
    SELECT id, array_to_string(list_transform(path, lambda k: {label('k')}), ' / ') AS breadcrumb,
      regexp_replace(array_to_string(list_transform(path, lambda k: CASE WHEN regexp_matches(k, '^[_A-Za-z][_A-Za-z0-9]*$')
        THEN '.' || k ELSE '["' || k || '"]' END), ''), '^\\.', '') AS access FROM placed""",
    ("nodes",),
)
def tree_path(spark, d):
    return placed(spark, d).select(
        "id", T.breadcrumb(F.col("path")).alias("breadcrumb"), T.access_path(F.col("path")).alias("access")
    )


BELOW = """below AS (
  SELECT ids[2] AS root_id, depth - 1 AS below, key, kind, value, row_number() OVER (PARTITION BY ids[2], depth > 1 ORDER BY path, id) AS rn
  FROM placed JOIN nodes USING (id) WHERE depth >= 1)"""


@query(
    "footprint",
    f"""WITH RECURSIVE {PLACED}, {BELOW},
    used AS (SELECT *, CASE WHEN below > 0 THEN 1 ELSE 0 END AS entry FROM below)
    SELECT root_id, sum(entry * 16 + CASE kind WHEN 'string' THEN strlen(value) WHEN 'table' THEN 48 WHEN 'function' THEN 16 ELSE 8 END
        + entry * strlen(key))::BIGINT AS bytes,
      count(*) FILTER (kind = 'table') AS tables, sum(entry)::BIGINT AS entries,
      count(*) FILTER (kind = 'string') + sum(entry)::BIGINT AS strings, count(*) FILTER (kind = 'function') AS functions,
      false AS truncated
    FROM used GROUP BY root_id""",
    ("nodes",),
)
def footprint(spark, d):
    return T.footprint(V.nodes(spark, d))


@query(
    "graph_counts",
    f"""WITH RECURSIVE {PLACED}, {BELOW}
    SELECT root_id, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'function') AS functions,
      count(*) FILTER (kind = 'string') AS strings, count(*) FILTER (below > 0) AS entries, false AS truncated FROM below GROUP BY root_id""",
    ("nodes",),
)
def graph_counts(spark, d):
    return T.graph_counts(V.nodes(spark, d))


@query(
    "key_search",
    f"""WITH RECURSIVE {PLACED},
    hits AS (SELECT ids[1] AS doc_id, id, key, path, kind, value, CASE WHEN lower(key) = 'cold ring' THEN 1
        WHEN strpos(lower(key), 'cold ring') = 1 THEN 2 WHEN strpos(lower(key), 'cold ring') > 1 THEN 3 END AS match
      FROM placed JOIN nodes USING (id) WHERE depth >= 1)
    SELECT doc_id, id, key, match, count(*) OVER (PARTITION BY doc_id) AS total_matches,
      row_number() OVER (PARTITION BY doc_id ORDER BY match, key, path) AS rank,
      CASE kind WHEN 'string' THEN '"' || value || '"' WHEN 'table' THEN 'table' ELSE value END AS preview
    FROM hits WHERE match IS NOT NULL QUALIFY rank <= 200""",
    ("nodes",),
)
def key_search(spark, d):
    return T.key_search(placed(spark, d), " Cold RING").select("doc_id", "id", "key", "match", "total_matches", "rank", "preview")


@query(
    "search_fallback",
    f"""WITH RECURSIVE {PLACED},
    q AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'no such key' WHEN 2 THEN '_' || c_custkey ELSE lower(split_part(p_name, ' ', 1)) END AS needle,
        c_custkey % 50 AS scope_id FROM customer JOIN (SELECT p_partkey, p_name FROM part WHERE p_partkey < 100) ON p_partkey = c_custkey % 100),
    hits AS (SELECT query_id, id, key, path, coalesce(list_position(ids, scope_id) > 0 AND depth + 1 - list_position(ids, scope_id) >= 1, false) AS loc, depth = 1 AS toplevel,
        CASE WHEN lower(key) = needle THEN 1 WHEN strpos(lower(key), needle) = 1 THEN 2 ELSE 3 END AS match
      FROM placed JOIN nodes USING (id) JOIN q ON contains(lower(key), needle)),
    u AS (SELECT *, 'local' AS scope FROM hits WHERE loc UNION ALL
          SELECT *, 'global' AS scope FROM hits WHERE toplevel AND query_id NOT IN (SELECT query_id FROM hits WHERE loc))
    SELECT query_id, scope, id, key, match, count(*) OVER (PARTITION BY query_id) AS total_matches,
      row_number() OVER (PARTITION BY query_id ORDER BY match, key, path) AS rank FROM u QUALIFY rank <= 5""",
    ("nodes",),
)
def search_fallback(spark, d):
    k = F.col("c_custkey")
    words = V.table(spark, d, "part").filter("p_partkey < 100").select("p_partkey", F.split("p_name", " ")[0].alias("word"))
    asked = V.table(spark, d, "customer").withColumn("p_partkey", k % 100).join(words, "p_partkey").select(
        k.alias("query_id"),
        F.when(k % 4 == 0, "Ring ").when(k % 4 == 1, "no such key").when(k % 4 == 2, F.concat(F.lit("_"), k.cast("string"))).otherwise(F.col("word")).alias("needle"),
        (k % 50).alias("scope_id"),
    )
    return T.search_fallback(placed(spark, d), asked, limit=5)


@query(
    "canonical_key_order",
    """SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY t, number NULLS FIRST, text, id) AS position FROM (
      SELECT id % 3 AS grp, id, CASE id % 7 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 6 THEN 4 ELSE 2 END AS t,
        CASE WHEN id % 7 = 0 THEN 10 - id * 1.5::DOUBLE END AS number,
        CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN id % 2 = 0 THEN '1' ELSE '0' END WHEN 2 THEN '' WHEN 6 THEN 'function:' || key ELSE key END AS text
      FROM nodes)""",
    ("nodes",),
)
def canonical_key_order(spark, d):
    k = F.col("id") % 7
    keys = V.nodes(spark, d).select(
        (F.col("id") % 3).alias("grp"),
        "id",
        F.when(k == 0, "number").when(k == 1, "boolean").when(k == 2, "secret").when(k == 6, "function").otherwise("string").alias("key_type"),
        F.when(k == 0, 10 - F.col("id") * 1.5).alias("number"),
        F.when(k.isin(0, 2), "").when(k == 1, F.when(F.col("id") % 2 == 0, "1").otherwise("0"))
        .when(k == 6, F.concat(F.lit("function:"), "key")).otherwise(F.col("key")).alias("text"),
    )
    return T.canonical_key_order(keys, ["grp"]).select("grp", "id", "position")


@query(
    "child_pages",
    """SELECT lang AS parent_id, doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'doc' || doc_id ELSE doc_id::VARCHAR END AS key, row_number() OVER w AS position, (row_number() OVER w - 1) // 200 AS page,
      least(((row_number() OVER w - 1) // 200 + 1) * 200, count(*) OVER (PARTITION BY lang)) AS loaded_count,
      ((row_number() OVER w - 1) // 200 + 1) * 200 < count(*) OVER (PARTITION BY lang) AS has_more
    FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id % 2 = 0, CASE WHEN doc_id % 2 = 1 THEN doc_id END, 'doc' || doc_id, doc_id)""",
)
def child_pages(spark, d):
    children = V.table(spark, d, "documents").select(
        F.col("lang").alias("parent_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("key")
    )
    return T.child_pages(children)


@query(
    "path_resolve",
    """SELECT id AS request_id, 0::BIGINT AS doc_id, CASE WHEN id % 10 IN (1, 2, 3) THEN NULL ELSE id END AS id, CASE WHEN id % 10 NOT IN (1, 2, 3) THEN kind END AS kind,
      CASE id % 10 WHEN 1 THEN 'path_invalid' WHEN 2 THEN 'not_found' WHEN 3 THEN 'path_required' ELSE 'found' END AS status FROM nodes""",
    ("nodes",),
)
def path_resolve(spark, d):
    tree = placed(spark, d)
    path = T.access_path(F.col("path"))
    k = F.col("id") % 10
    requests = tree.select(
        F.col("id").alias("request_id"),
        "doc_id",
        F.when(k == 1, F.concat(path, F.lit("..x"))).when(k == 2, F.concat(path, F.lit("[3]"))).when(k == 3, "  ")
        .when(k % 2 == 0, F.concat(F.lit(" _G."), path)).otherwise(path).alias("path"),
    )
    return T.path_resolve(requests, tree)


@query(
    "graph_reach",
    """WITH RECURSIVE r AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT 97, 0
      UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = id WHERE depth < 40)
    SELECT id, min(depth)::INTEGER AS depth, false AS truncated FROM r GROUP BY id""",
    ("edges",),
)
def graph_reach(spark, d):
    roots = V.nodes(spark, d).filter("id = 1 OR id = 97").select("id")
    return G.graph_reach(V.edges(spark, d), roots)


@query(
    "owner_frames",
    """WITH RECURSIVE r AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = id WHERE depth < 40),
    u AS (SELECT id AS object_id, 1 AS g, 0 AS s FROM r UNION ALL SELECT object_id, 0, 1 FROM object_snapshots WHERE contains(location, '/Brand7/'))
    SELECT object_id, max(g)::INTEGER AS via_graph, max(s)::INTEGER AS via_source FROM u GROUP BY object_id""",
    ("edges", "object_snapshots"),
)
def owner_frames(spark, d):
    reached = G.graph_reach(V.edges(spark, d), V.nodes(spark, d).filter("id = 1").select("id"))
    return G.owner_frames(V.object_snapshots(spark, d), "Brand7", reached)


def closure(spark, d):
    """Three builds load XML files that follow the reference graph; some targets are missing or outside."""
    name = lambda c: F.concat(F.lit("d"), (F.col(c) % 4).cast("string"), F.lit("/F"), F.col(c).cast("string"), F.lit(".xml"))
    nodes = V.nodes(spark, d)
    entries = nodes.filter("id BETWEEN 1 AND 3").select((F.col("id") - 1).alias("build"), name("id").alias("path"))
    files = nodes.filter("id % 13 <> 0").select(name("id").alias("path"))
    references = V.edges(spark, d).select(
        name("src").alias("src"),
        F.when(F.col("dst") % 101 == 0, F.concat(F.lit("../../F"), F.col("dst").cast("string")))
        .otherwise(F.concat(F.lit("..\\"), F.lower(name("dst")))).alias("reference"),
    )
    return G.load_closure(entries, references, files)


CLOSURE = """
r AS (SELECT i AS build, (i + 1)::BIGINT AS id, 0 AS depth FROM range(0, 3) t(i)
  UNION SELECT build, dst, depth + 1 FROM r JOIN edges ON src = id
  WHERE depth < 60 AND id % 13 <> 0 AND (depth = 0 OR id % 101 <> 0)),
c AS (SELECT build, id, min(depth)::INTEGER AS depth FROM r GROUP BY build, id)"""


@query(
    "load_closure",
    f"""WITH RECURSIVE {CLOSURE}
    SELECT build, 'd' || (id % 4) || '/F' || id || '.xml' AS path, depth FROM c WHERE id % 13 <> 0 AND id % 101 <> 0""",
    ("edges",),
)
def load_closure(spark, d):
    return closure(spark, d)[0]


@query(
    "load_findings",
    f"""WITH RECURSIVE {CLOSURE}
    SELECT build, CASE WHEN id % 101 = 0 THEN 'load-path-escape' ELSE 'missing-load-file' END AS finding,
      CASE WHEN id % 101 = 0 THEN '../../F' || id ELSE 'd' || (id % 4) || '/f' || id || '.xml' END AS path FROM c WHERE id % 13 = 0 OR id % 101 = 0""",
    ("edges",),
)
def load_findings(spark, d):
    return closure(spark, d)[1].select("build", "finding", "path")


def json_docs(spark, d):
    """One JSON document per event."""
    e = V.table(spark, d, "events")
    body = F.to_json(F.struct(
        F.col("event_type").alias("name"),
        F.struct(F.col("event_id").alias("k"), (F.col("event_id") % 2 == 0).alias("even")).alias("meta"),
        F.array(F.col("user_id"), F.col("user_id") + 1).alias("users"),
    ))
    return e.select("event_id", F.when(F.col("event_id") % 100 != 0, body).otherwise("{broken").alias("content"))


@query(
    "tree_flatten_json",
    """WITH e AS (SELECT * FROM events WHERE event_id % 100 <> 0),
    n AS (SELECT event_id, 0 AS position, 0 AS depth, '' AS path, 'table' AS kind, 'Table' AS value FROM e
      UNION ALL SELECT event_id, 1, 1, 'meta', 'table', 'Table' FROM e
      UNION ALL SELECT event_id, 2, 2, 'meta/even', 'boolean', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END FROM e
      UNION ALL SELECT event_id, 3, 2, 'meta/k', 'number', event_id::VARCHAR FROM e
      UNION ALL SELECT event_id, 4, 1, 'name', 'string', '"' || event_type || '"' FROM e
      UNION ALL SELECT event_id, 5, 1, 'users', 'table', 'Table' FROM e
      UNION ALL SELECT event_id, 6, 2, 'users/1', 'number', user_id::VARCHAR FROM e
      UNION ALL SELECT event_id, 7, 2, 'users/2', 'number', (user_id + 1)::VARCHAR FROM e)
    SELECT event_id, position::INTEGER AS position, depth::INTEGER AS depth, path, kind, value, false AS truncated FROM n""",
)
def tree_flatten_json(spark, d):
    return D.variant_nodes(json_docs(spark, d), "event_id", "content").select(
        "event_id", "position", "depth", F.array_join("path", "/").alias("path"), "kind", "value", "truncated"
    )


def declared_documents(spark, d):
    """Documents owned by users, some of them broken; every third is declared, and so are some that never existed."""
    docs = json_docs(spark, d).filter("event_id % 100 <> 0 OR event_id % 200 = 0").join(
        V.table(spark, d, "events").select("event_id", F.col("user_id").alias("owner")), "event_id"
    ).select("owner", F.concat(F.lit("DB_"), F.col("event_id").cast("string")).alias("name"), "content")
    listing = V.table(spark, d, "events").filter("event_id % 3 = 0").select(
        F.col("user_id").alias("owner"), F.concat(F.lit("DB_"), F.col("event_id").cast("string"), F.lit(", DB_"), F.col("event_id").cast("string")).alias("text")
    )
    declared = listing.select("owner", F.explode(names_of(F.col("text"))).alias("name"))
    return docs, declared


@query(
    "variable_names",
    """SELECT event_id, 'DB_' || event_id || '|_x1|y' AS names FROM events""",
)
def variable_names(spark, d):
    name = F.concat(F.lit("DB_"), F.col("event_id").cast("string"))
    declared = F.concat(name, F.lit(", _x1;"), name)
    return V.table(spark, d, "events").select("event_id", F.array_join(names_of(declared, F.lit("y _x1 7")), "|").alias("names"))


@query(
    "document_scan",
    """SELECT user_id AS owner, 'DB_' || event_id AS name, event_id % 100 <> 0 OR event_id % 200 = 0 AS loaded FROM events WHERE event_id % 3 = 0""",
)
def document_scan(spark, d):
    docs, declared = declared_documents(spark, d)
    return D.document_scan(docs, declared).select("owner", "name", F.col("content").isNotNull().alias("loaded"))


@query(
    "document_footprint",
    """SELECT source AS owner, 'DB_' || doc_id AS name, true AS loaded,
      CASE WHEN doc_id % 50 = 0 THEN 8 ELSE 48 + 4 * 16 + strlen('lang') + strlen('n_chars') + strlen('source') + strlen('text')
        + strlen(lang) + 8 + 1 + strlen(text) + 4 END::BIGINT AS bytes,
      CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 1 END::BIGINT AS tables, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 4 END::BIGINT AS entries,
      CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 7 END::BIGINT AS strings, false AS truncated
    FROM documents
    UNION ALL SELECT source, 'Never_' || doc_id, false, 8, 0, 0, 0, false FROM documents WHERE doc_id % 3 = 0""",
)
def document_footprint(spark, d):
    docs = wide_docs(spark, d, F.concat("text", F.lit("\r\0\n\"")))
    owned = docs.join(V.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    have = owned.select(
        F.col("source").alias("owner"), F.concat(F.lit("DB_"), F.col("doc_id").cast("string")).alias("name"),
        F.when(F.col("doc_id") % 50 != 0, F.col("content")).otherwise("{broken").alias("content"),
    )
    never = owned.filter("doc_id % 3 = 0").select(F.col("source").alias("owner"), F.concat(F.lit("Never_"), F.col("doc_id").cast("string")).alias("name"))
    return D.document_footprint(D.document_scan(have, have.select("owner", "name").unionByName(never)))


CANONICAL = """'{' || chr(10) || '  ["lang"] = "' || lang || '",' || chr(10) || '  ["n_chars"] = ' || n_chars || ',' || chr(10)
  || '  ["source"] = "' || (doc_id % 2) || '",' || chr(10) || '  ["text"] = "'
  || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\' || chr(10)), chr(13), '\\r') || '",' || chr(10) || '}'"""


def wide_docs(spark, d, text=None):
    body = F.to_json(F.struct((F.col("text") if text is None else text).alias("text"), (F.col("doc_id") % 2).cast("string").alias("source"), "n_chars", "lang"))
    return V.table(spark, d, "documents").select("doc_id", body.alias("content"))


@query(
    "canonical_text",
    f"""SELECT sha256(t) AS fingerprint, min(doc_id) AS first_id, count(*) AS copies, max(strlen(t))::INTEGER AS bytes
    FROM (SELECT doc_id, {CANONICAL} AS t FROM documents) GROUP BY 1""",
)
def canonical_text(spark, d):
    return D.fingerprints(wide_docs(spark, d), "doc_id", "content")


@query(
    "tree_from_text",
    """WITH n AS (SELECT event_id, 0 AS position, 0 AS depth, '[1]' AS path, 'table' AS kind, 'Table (3 entries)' AS value FROM events WHERE event_id % 100 <> 0
      UNION ALL SELECT event_id, 1, 1, '[1]/meta', 'table', 'Table (2 entries)' FROM events WHERE event_id % 100 <> 0
      UNION ALL SELECT event_id, 2, 2, '[1]/meta/even', 'boolean', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END FROM events WHERE event_id % 100 <> 0
      UNION ALL SELECT event_id, 3, 2, '[1]/meta/k', 'number', event_id::VARCHAR FROM events WHERE event_id % 100 <> 0
      UNION ALL SELECT event_id, 4, 1, '[1]/name', 'string', '"' || event_type || '"' FROM events WHERE event_id % 100 <> 0
      UNION ALL SELECT event_id, 5, 1, '[1]/users', 'table', 'Table (2 entries)' FROM events WHERE event_id % 100 <> 0
      UNION ALL SELECT event_id, 6, 2, '[1]/users/[1]', 'number', user_id::VARCHAR FROM events WHERE event_id % 100 <> 0
      UNION ALL SELECT event_id, 7, 2, '[1]/users/[2]', 'number', (user_id + 1)::VARCHAR FROM events WHERE event_id % 100 <> 0)
    SELECT event_id, position::INTEGER AS position, depth::INTEGER AS depth, path, kind, value FROM n""",
)
def tree_from_text(spark, d):
    docs = json_docs(spark, d)
    good = D.canonical_documents(docs, "event_id", "content").select("event_id", F.concat(F.lit("log line\n[1] = "), "text").alias("result"))
    entries = good.unionByName(docs.filter("content = '{broken'").select("event_id", F.lit("[1] = {[").alias("result")))
    return D.tree_from_text(entries, "result", ["event_id"]).select(
        "event_id", "position", "depth", F.array_join("path", "/").alias("path"), "kind", "value"
    )


@query(
    "metadata_bound",
    """SELECT event_id AS record_id, u.*, false AS truncated FROM events, (VALUES ('flag', 'boolean', 'true'), ('inner', 'map', ''), ('inner.n', 'number', '5')) u(key_path, type, text)
    WHERE event_id % 100 <> 0
    UNION ALL SELECT event_id, 'name', 'string', left(repeat(event_type, event_id % 900 + 1), 2048), length(event_type) * (event_id % 900 + 1) > 2048
    FROM events WHERE event_id % 100 <> 0""",
)
def metadata_bound(spark, d):
    from fieldscope.operators.evidence import metadata_bound as bound

    body = F.to_json(F.struct(
        F.expr("repeat(event_type, cast(event_id % 900 + 1 as int))").alias("name"), F.lit(True).alias("flag"),
        F.struct(F.lit(5).alias("n"), F.struct(F.lit(1).alias("x")).alias("deep")).alias("inner"),
    ))
    events = spread(V.table(spark, d, "events").select("event_id", "event_type"))
    return bound(events.select(F.col("event_id").alias("record_id"), F.when(F.col("event_id") % 100 != 0, body).otherwise("{broken").alias("metadata")))
