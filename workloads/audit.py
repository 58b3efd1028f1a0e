"""Source corpora, manifests, catalogs and audit findings."""

from pyspark.sql import functions as F

from fieldscope.operators import audit as A
from workloads import views as V
from workloads.registry import query

LINES = """
source_lines AS (
  SELECT build, file, i::INTEGER AS line_no, parts[i] AS line
  FROM (SELECT build, file, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT build, file, string_split(text, chr(10)) AS parts FROM source_files WHERE file LIKE '%.lua')))"""

CALL = 'href='
LITERAL = 'href="(/[a-z][^"]*)"'
BRANCHES = (r'lang="(?:fr|de)"', r"track\(", r"\bcopyright\b")
LEGACY = r"(?<![\w.])(?:track|stop)\s*\("


def lines(spark, d):
    return A.source_lines(V.source_files(spark, d))


def page_catalog(spark, d):
    """Catalog of a build: the links of its even pages."""
    even = V.table(spark, d, "pages").filter("page_id % 2 = 0")
    found = F.explode(F.regexp_extract_all("html", F.lit(LITERAL), F.lit(1)))
    return even.select((F.col("page_id") % 3).alias("build"), found.alias("event_name")).distinct()


CATALOG = f"""page_catalog AS (SELECT DISTINCT page_id % 3 AS build, unnest(regexp_extract_all(html, '{LITERAL}', 1)) AS event_name
  FROM pages WHERE page_id % 2 = 0)"""
USES = f"uses AS (SELECT build, file, line_no, unnest(regexp_extract_all(line, '{LITERAL}', 1)) AS event FROM source_lines)"
UNAVAILABLE = """unavailable AS (SELECT 'event-unavailable' AS id, 'error' AS severity, build, file, line_no AS line,
  'Event ' || event || ' is not documented for this client ref.' AS message, event AS evidence
  FROM uses u WHERE NOT EXISTS (SELECT 1 FROM page_catalog c WHERE c.build = u.build AND c.event_name = u.event))"""
BRANCH = "branches AS (" + " UNION ALL ".join(
    f"""SELECT 'scattered-product-branch' AS id, 'warning' AS severity, build, file, line_no AS line,
    'Client-product branching is outside the compatibility boundary.' AS message, regexp_extract(line, '{p}', 0) AS evidence
    FROM source_lines WHERE regexp_matches(line, '{p}') AND file NOT LIKE 'src/1%'"""
    for p in BRANCHES
) + ")"
LEGACY_SQL = r"""legacy AS (SELECT 'legacy-addon-api' AS id, 'warning' AS severity, build, file, line_no AS line,
  'An old addon function is called outside the compatibility files.' AS message,
  regexp_extract(line, '(?:^|[^\w.])((?:track|stop)\s*\()', 1) AS evidence
  FROM source_lines WHERE regexp_matches(line, '(?:^|[^\w.])((?:track|stop)\s*\()') AND file NOT LIKE 'src/1%')"""


def outside():
    return A.outside_boundary("", "src/1")


def unavailable(spark, d):
    return A.unavailable_events(A.literal_events(lines(spark, d), LITERAL), page_catalog(spark, d))


def branches(spark, d):
    return A.branch_scan(lines(spark, d), BRANCHES, outside())


def legacy(spark, d):
    return A.legacy_api_scan(lines(spark, d), LEGACY, outside())


@query("source_lines", f"WITH {LINES} SELECT * FROM source_lines", ("source_files",))
def source_lines(spark, d):
    return lines(spark, d)


@query("literal_events", f"WITH {LINES}, {USES} SELECT * FROM uses", ("source_files",))
def literal_events(spark, d):
    return A.literal_events(lines(spark, d), LITERAL)


@query("unavailable_events", f"WITH {LINES}, {USES}, {CATALOG}, {UNAVAILABLE} SELECT * FROM unavailable", ("source_files",))
def unavailable_events(spark, d):
    return unavailable(spark, d)


@query(
    "dynamic_registrations",
    f"""WITH {LINES} SELECT build, file, line_no FROM source_lines
    WHERE regexp_matches(line, '{CALL}') AND NOT regexp_matches(line, '{LITERAL}')""",
    ("source_files",),
)
def dynamic_registrations(spark, d):
    return A.dynamic_registrations(lines(spark, d), CALL, LITERAL).select("build", "file", "line_no")


@query("branch_scan", f"WITH {LINES}, {BRANCH} SELECT * FROM branches", ("source_files",))
def branch_scan(spark, d):
    return branches(spark, d)


@query("legacy_api_scan", f"WITH {LINES}, {LEGACY_SQL} SELECT * FROM legacy", ("source_files",))
def legacy_api_scan(spark, d):
    return legacy(spark, d)


@query(
    "findings_union",
    f"""WITH {LINES}, {USES}, {CATALOG}, {UNAVAILABLE}, {BRANCH}, {LEGACY_SQL}
    SELECT * FROM unavailable UNION ALL SELECT * FROM branches UNION ALL SELECT * FROM legacy""",
    ("source_files",),
)
def findings_union(spark, d):
    return A.findings_union(unavailable(spark, d), branches(spark, d), legacy(spark, d))


@query(
    "audit_summary",
    f"""WITH {LINES}, {USES}, {CATALOG}, {UNAVAILABLE}, {BRANCH}, {LEGACY_SQL},
    u AS (SELECT severity FROM unavailable UNION ALL SELECT severity FROM branches UNION ALL SELECT severity FROM legacy)
    SELECT count(*) FILTER (severity = 'error') = 0 AS passed, count(*) FILTER (severity = 'error') AS errors,
      count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info FROM u""",
    ("source_files",),
)
def audit_summary(spark, d):
    return A.audit_summary(findings_union(spark, d))


@query(
    "audit_client_stats",
    f"""WITH {LINES}, f AS (SELECT build, count(DISTINCT file) AS closure_files, count(DISTINCT file) FILTER (file LIKE '%.lua') AS lua_files
      FROM source_files GROUP BY build),
    l AS (SELECT build, sum(len(regexp_extract_all(line, '{LITERAL}')))::BIGINT AS literal_events,
        count(*) FILTER (regexp_matches(line, '{CALL}') AND NOT regexp_matches(line, '{LITERAL}')) AS dynamic_registrations
      FROM source_lines GROUP BY build)
    SELECT * FROM f JOIN l USING (build)""",
    ("source_files",),
)
def audit_client_stats(spark, d):
    return A.audit_client_stats(V.source_files(spark, d), lines(spark, d), CALL, LITERAL)


def expected(spark, d):
    """What every build should have; build 3 exists only here."""
    builds = V.table(spark, d, "region").filter("r_regionkey < 4").select(F.col("r_regionkey").cast("bigint").alias("build"))
    b = F.col("build").cast("string")
    return builds.select(
        "build",
        F.concat(F.lit("100"), b).alias("interface"),
        F.concat(F.lit("Core/Clients/c"), b, F.lit(".lua")).alias("profile"),
        F.concat(F.lit("Modules/Events/CatalogData_c"), F.when(F.col("build") == 2, "9").otherwise(b), F.lit(".lua")).alias("catalog"),
    )


@query(
    "manifest_checks",
    """SELECT * FROM (VALUES
      (0, 'compatibility-load-order', 'expected=Core/Clients/c0.lua,Core/Compatibility.lua'),
      (1, 'interface-mismatch', 'expected=1001; actual=1009'),
      (1, 'ambiguous-toc', '2'),
      (2, 'event-catalog-mismatch', 'expected=Modules/Events/CatalogData_c9.lua; actual=Modules/Events/CatalogData_c2.lua'),
      (3, 'missing-toc', '1003')) f(build, id, evidence)
    WHERE (SELECT count(*) FROM supplier) > 9""",
)
def manifest_checks(spark, d):
    manifest = V.manifest(spark, d)
    builds = manifest.select("build").distinct()
    named = builds.select("build", F.explode(F.when(F.col("build") == 1, F.array(F.lit("a.toc"), F.lit("b.toc"))).otherwise(F.array(F.lit("a.toc")))).alias("manifest"))
    meta = builds.select("build", F.lit("Interface").alias("key"), F.when(F.col("build") == 1, "1009").otherwise(F.concat(F.lit("100"), F.col("build").cast("string"))).alias("value"))
    return A.manifest_checks(expected(spark, d), named, meta, manifest).select("build", "id", "evidence")


@query(
    "manifest_missing_files",
    """SELECT build, path AS file, 'missing-load-file' AS id FROM manifest
    WHERE path NOT IN (SELECT path FROM manifest WHERE build > 0 AND ord % 5 <> 0)""",
    ("manifest",),
)
def manifest_missing_files(spark, d):
    manifest = V.manifest(spark, d)
    present = manifest.filter("build > 0 AND ord % 5 <> 0").select("path").distinct()
    return A.manifest_missing_files(manifest, present).select("build", "file", "id")


@query(
    "load_order_divergence",
    """WITH n AS (SELECT build, ord, CASE WHEN path LIKE 'Core/Clients/%.lua' THEN 'Core/Clients/<client>.lua'
        WHEN path LIKE 'Modules/Events/CatalogData\\_%.lua' ESCAPE '\\' THEN 'Modules/Events/CatalogData_<client>.lua' ELSE path END AS path FROM manifest),
    l AS (SELECT build, string_agg(path, chr(10) ORDER BY ord) AS listing FROM n GROUP BY build)
    SELECT build, listing <> (SELECT listing FROM l WHERE build = 1) AS diverged FROM l""",
    ("manifest",),
)
def load_order_divergence(spark, d):
    return A.load_order_divergence(V.manifest(spark, d), 1).select("build", "diverged")


def manifest_texts(spark, d):
    """A manifest text per supplier, with both line ends, comments and both slashes."""
    k = F.col("s_suppkey").cast("string")
    return V.table(spark, d, "supplier").select(
        F.col("s_name").alias("manifest"),
        F.concat(
            F.lit("## Interface: 1000"), k, F.lit("\r\n##  Title: Addon "), F.col("s_name"), F.lit("  \r\n# comment\n\nCore\\Boot\\a"),
            k, F.lit(".lua\r\n#skip.lua\nUI/b.xml\r\n## Interface: 2000"), k, F.lit("\nz.lua"),
        ).alias("content"),
    )


@query(
    "manifest_read",
    """SELECT s_name AS manifest, u.kind, u.name, u.text FROM supplier, LATERAL (VALUES
      ('meta', 'Interface', '2000' || s_suppkey), ('meta', 'Title', 'Addon ' || s_name),
      ('file', '0', 'Core/Boot/a' || s_suppkey || '.lua'), ('file', '1', 'UI/b.xml'), ('file', '2', 'z.lua')) u(kind, name, text)""",
)
def manifest_read(spark, d):
    metadata, paths = A.manifest_read(manifest_texts(spark, d))
    return metadata.select("manifest", F.lit("meta").alias("kind"), F.col("key").alias("name"), F.col("value").alias("text")).unionByName(
        paths.select("manifest", F.lit("file").alias("kind"), F.col("ord").cast("string").alias("name"), F.col("path").alias("text"))
    )


def documentation(spark, d):
    """Generated documentation text: one file per catalog entry, with an entry that is no event beside it."""
    argument = lambda name: F.concat(F.lit('\t\t\t\t{ Name = "'), name, F.lit('", Type = "cstring", Nilable = false },\n'))
    payload = F.concat(F.lit("\t\t\tPayload =\n\t\t\t{\n"), argument(F.col("signature")), argument(F.lit("extra")), F.lit("\t\t\t},\n"))
    return V.catalog(spark, d).select(
        "build",
        F.concat("event_name", F.lit("Documentation.lua")).alias("path"),
        F.concat(
            F.lit('local Doc =\n{\n\tEvents =\n\t{\n\t\t{\n\t\t\tName = "Some",\n\t\t\tType = "Event",\n\t\t\tLiteralName = "'), "event_name",
            F.lit('",\n'), F.when(F.col("signature") == "", "").otherwise(payload),
            F.lit('\t\t},\n\t\t{\n\t\t\tName = "Other",\n\t\t\tType = "Function",\n\t\t},\n\t},\n}\n'),
        ).alias("content"),
    )


@query(
    "catalog_extract",
    "SELECT build, event_name, CASE WHEN signature <> '' THEN signature || ', extra' ELSE '' END AS signature FROM catalog",
    ("catalog",),
)
def catalog_extract(spark, d):
    return A.catalog_extract(documentation(spark, d))


@query("catalog_read", "SELECT build, event_name FROM catalog", ("catalog",))
def catalog_read(spark, d):
    line = F.concat(F.lit('    "'), "event_name", F.lit('", "'), "signature", F.lit('",'))
    listed = V.catalog(spark, d).select("build", line.alias("line"))
    return A.catalog_read(listed.unionByName(listed).unionByName(listed.withColumn("line", F.lit("ns.Data = {"))))


@query(
    "audit_report_sink",
    f"""WITH {LINES}, {USES}, {CATALOG}, {UNAVAILABLE}, {BRANCH}, {LEGACY_SQL}
    SELECT id, severity, build, file, line, evidence FROM (SELECT * FROM unavailable UNION ALL SELECT * FROM branches UNION ALL SELECT * FROM legacy)""",
    ("source_files",),
)
def audit_report_sink(spark, d):
    from fieldscope.session import fresh_dir
    from fieldscope.sources.files import write_report

    path = fresh_dir(spark, "audit")
    findings = findings_union(spark, d)
    write_report(findings, A.audit_summary(findings), audit_client_stats(spark, d), path, "generic")
    return spark.read.schema("id string, severity string, build bigint, file string, line int, evidence string").json(f"{path}/findings")
