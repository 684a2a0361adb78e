"""Resolution and search queries: B1, B15-B20, L1-L14, M1-M10."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.functions import text as X
from turfline.operators import resolution as L
from turfline.operators import search as M
from turfline.operators import similarity as S
from turfline.operators.ordering import with_midrank
from turfline.operators.profiles import melt
from turfline.plans.profiles import RATES, rounded
from turfline.plans.registry import query
from turfline.plans.similarity import FAM, Z_SQL, scaled

UUID_SQL = """lower(h[1:8]) || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(('0x' || h[17:17])::INT % 4 + 1 AS INT), 1) || h[18:20] || '-' || h[21:32]"""


@query(
    "entity_keys",
    "B1",
    f"""WITH k AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST('fri:statsbomb:players:' || c_custkey AS BLOB)) AS h FROM customer)
SELECT c_custkey, {UUID_SQL} AS entity_id FROM k""",
)
def entity_keys(v):
    return v.table("customer").select(
        "c_custkey", X.entity_key("statsbomb", "players", "c_custkey").alias("entity_id")
    )


@query(
    "name_parts",
    "B8 B15 B17 B18 B19 B20",
    """SELECT c_custkey, 'openfootball-club-' || substr(sha256(c_mktsegment || chr(0) || c_name), 1, 20) AS short_id,
 'é' || c_name AS decoded, 2000 + c_nationkey AS first_year, 2001 + c_nationkey AS last_year,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'Estonia' ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Land' END AS country,
 CASE WHEN c_nationkey % 2 = 0 THEN c_name || ' ' || c_mktsegment ELSE 'n' || c_nationkey END AS full_name,
 CASE c_nationkey % 4 WHEN 0 THEN 'CB' WHEN 1 THEN 'FB/WB' WHEN 2 THEN 'W' END AS role FROM customer""",
)
def name_parts(v):
    n = F.col("c_nationkey")
    label = F.concat((2000 + n).cast("string"), F.lit("/"), (2001 + n).cast("string"))
    start, end = X.season_years(label)
    empty = F.when(n % 2 == 0, F.col("c_name"))
    second = F.when(n % 2 == 0, F.col("c_mktsegment"))
    folder = F.concat(F.lower("c_mktsegment"), F.lit("-land"))
    place = F.element_at(
        F.array(F.lit("Left Centre Back"), F.lit("Right Wing Back"), F.lit("Left Wing"), F.lit("Unknown")),
        (n % 4 + 1).cast("int"),
    )
    return v.table("customer").select(
        "c_custkey",
        X.short_identifier("club", F.col("c_mktsegment"), F.col("c_name")).alias("short_id"),
        X.decode_escapes(F.concat(F.lit("\\u00e9"), F.col("c_name"))).alias("decoded"),
        start.alias("first_year"),
        end.alias("last_year"),
        X.folder_country(folder, {"building-land": "Estonia"}).alias("country"),
        X.assembled_name(empty, second, F.concat(F.lit("n"), n.cast("string"))).alias("full_name"),
        X.position_group(place).alias("role"),
    )


NORM = "trim(regexp_replace(regexp_replace(replace(lower(strip_accents({c})), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
NAMED = "CASE turn % 3 WHEN 0 THEN 'Άρης Θεσσαλονίκης' WHEN 1 THEN 'Андрей Йорданов' ELSE 'Ñandú' END || ' ' || text"


@query(
    "normalised_text",
    "B16",
    f"SELECT conv_id, turn, {NORM.format(c=f'replace({NAMED}, chr(223), chr(115) || chr(115))')} AS plain FROM conversations",
)
def normalised_text(v):
    return v.table("conversations").select("conv_id", "turn", X.normalise_name(F.expr(NAMED)).alias("plain"))


def club_lines(v):
    """Club sheets written from parts: one file per brand, alias lines, noise."""
    p = v.table("part")
    key = F.col("p_partkey") * 4
    lines = F.array(
        F.struct(key.alias("line"), F.concat(F.initcap("p_name"), F.lit(", 1900, @ "), F.col("p_type"), F.lit(" Park, x  # note")).alias("raw")),
        F.struct((key + 1).alias("line"), F.concat(F.lit("| "), F.upper("p_name"), F.lit(" | FC "), F.col("p_size").cast("string"), F.lit(" |")).alias("raw")),
        F.struct((key + 2).alias("line"), F.when(F.col("p_size") % 10 == 0, "@ nowhere").otherwise("== x").alias("raw")),
        F.struct((key + 3).alias("line"), F.lit("").alias("raw")),
    )
    return p.select(
        F.col("p_brand").alias("file"), F.col("p_type").alias("nation0"), F.explode(lines).alias("l")
    ).select("file", F.col("file").alias("nation"), "l.line", "l.raw")


TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"


@query(
    "club_sheets",
    "A4 L1",
    f"""SELECT p_brand AS source, p_partkey * 4 AS source_line, {TITLE} AS name, upper(p_name) || ';FC ' || p_size AS aliases, p_type || ' Park' AS stadium,
 'openfootball-club-' || substr(sha256(p_brand || chr(0) || p_name), 1, 20) AS club_id FROM part""",
)
def club_sheets(v):
    clubs, _ = L.parse_clubs(club_lines(v))
    return clubs.select(
        "source", "source_line", "name", F.array_join("aliases", ";").alias("aliases"), "stadium", "club_id"
    )


@query(
    "club_rejects",
    "L1",
    "SELECT p_brand AS file, p_partkey * 4 + 2 AS line, 'unrecognized_club_row' AS reason FROM part WHERE p_size % 10 = 0",
)
def club_rejects(v):
    return L.parse_clubs(club_lines(v))[1].drop("raw")


PLAYER_DAY = "1990 + o_orderkey % 15"


@query(
    "player_sheets",
    "L2",
    """SELECT o_orderpriority AS source, o_orderkey AS source_line, 'Person ' || o_custkey AS name, make_date(CAST(1980 + o_orderkey % 20 AS INT), 9, CAST(1 + o_orderkey % 28 AS INT)) AS dob,
 CASE WHEN o_custkey % 2 = 0 THEN 1.75e0 END AS height_m, CASE WHEN o_orderstatus = 'F' THEN 'D|MF' ELSE 'GK' END AS position FROM orders WHERE o_orderstatus <> 'P'""",
)
def player_sheets(v):
    return L.parse_players(player_lines(v))[0].select(
        "source", "source_line", "name", "dob", "height_m", "position"
    )


def player_lines(v):
    k = F.col("o_orderkey")
    post = F.when(F.col("o_orderstatus") == "F", "D|MF").when(F.col("o_orderstatus") == "O", "GK").otherwise("XX")
    raw = F.concat(
        F.lit("Person "), F.col("o_custkey").cast("string"), F.lit(", "), post, F.lit(", "),
        F.when(F.col("o_custkey") % 2 == 0, "1.75 m").otherwise("tall"), F.lit(", b. "),
        (1 + k % 28).cast("string"), F.lit(" Sept "), (1980 + k % 20).cast("string"), F.lit(" in Town, x"),
    )
    return v.table("orders").select(
        F.col("o_orderpriority").alias("file"), F.lit("n").alias("nation"), k.alias("line"), raw.alias("raw")
    )


@query(
    "player_rejects",
    "L2",
    "SELECT o_orderpriority AS file, o_orderkey AS line, 'unsupported_player_row' AS reason FROM orders WHERE o_orderstatus = 'P'",
)
def player_rejects(v):
    return L.parse_players(player_lines(v))[1].drop("raw")


def fixture_lines(v):
    """Fixture sheets from orders: one file per priority; dates and rounds as header lines."""
    k = F.col("o_orderkey")
    home, away = F.concat(F.lit("Club "), (F.col("o_custkey") % 30).cast("string")), F.concat(F.lit("Team "), (k % 30).cast("string"))
    goals = F.concat((k % 5).cast("string"), F.lit("-"), (k % 3).cast("string"))
    raw = (
        F.when(k % 11 == 0, F.concat(F.lit("Matchday "), k.cast("string")))
        .when(k % 11 == 1, F.concat(F.lit("Sat "), k.cast("string")))
        .when(k % 11 < 5, F.concat(F.lit("15:30  "), home, F.lit("   "), goals, F.lit(" (1-0)   "), away))
        .when(k % 11 < 8, F.concat(home, F.lit(" v "), away, F.lit("  "), goals))
        .when(k % 11 == 8, F.concat(home, F.lit(" v "), away, F.lit(" [postponed]")))
        .when(k % 11 == 9, F.concat(F.lit("odd 1:2 "), home))
        .otherwise(F.lit("# comment"))
    )
    return v.table("orders").select(
        F.col("o_orderpriority").alias("file"), k.alias("line"), raw.alias("raw")
    )


FIX_SQL = """fx AS (SELECT o_orderpriority AS file, o_orderkey AS k, o_custkey % 30 AS h, o_orderkey % 30 AS a,
  max(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END) OVER w AS md, max(CASE WHEN o_orderkey % 11 = 1 THEN o_orderkey END) OVER w AS dt
  FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fixed AS (SELECT file, k AS source_line, 'Club ' || h AS home, 'Team ' || a AS away, 'Sat ' || dt AS date_text, 'Matchday ' || md AS round,
  CASE WHEN k % 11 < 5 THEN '15:30' END AS time, CASE WHEN k % 11 < 8 THEN (k % 5) || '-' || (k % 3) END AS score, CASE WHEN k % 11 = 8 THEN '[postponed]' WHEN k % 11 BETWEEN 5 AND 7 THEN '' END AS score_note
  FROM fx WHERE k % 11 BETWEEN 2 AND 8)"""


@query(
    "fixture_sheets",
    "L3 L4",
    f"WITH {FIX_SQL} SELECT file, source_line, home, away, date_text, round, time, score, score_note FROM fixed",
)
def fixture_sheets(v):
    rows, _ = L.parse_fixtures(fixture_lines(v))
    return rows.withColumn("score", F.array_join(L.valid_score(F.col("score")).cast("array<string>"), "-")).select(
        "file", "source_line", "home", "away", "date_text", "round", "time", "score", "score_note"
    )


@query(
    "fixture_rejects",
    "L3",
    "SELECT o_orderpriority AS file, o_orderkey AS line, 'unsupported_fixture_syntax' AS reason FROM orders WHERE o_orderkey % 11 = 9",
)
def fixture_rejects(v):
    return L.parse_fixtures(fixture_lines(v))[1].drop("raw")


@query(
    "fixture_dedupe",
    "L8",
    f"WITH {FIX_SQL} SELECT file, round, home, away, min(source_line) AS source_line, count(*) - 1 AS duplicates FROM fixed GROUP BY file, round, home, away",
)
def fixture_dedupe(v):
    rows, _ = L.parse_fixtures(fixture_lines(v))
    keys = ["file", "round", "home", "away"]
    null_safe = rows.withColumn("round", F.coalesce("round", F.lit("-")))
    kept, extra = L.dedupe_fixtures(null_safe, keys, "source_line")
    out = kept.join(extra, keys, "left").select(
        *keys, "source_line", F.coalesce("duplicates", F.lit(0)).alias("duplicates")
    )
    return out.withColumn("round", F.nullif("round", F.lit("-")))


@query(
    "fixture_scopes",
    "L9",
    f"""WITH {FIX_SQL}, s AS (SELECT file, home AS club FROM fixed UNION SELECT file, away FROM fixed)
SELECT file, count(*) AS fixtures, count(score) AS results, (SELECT count(*) FROM s WHERE s.file = fixed.file) AS clubs FROM fixed GROUP BY file""",
)
def fixture_scopes(v):
    return L.fixture_scopes(L.parse_fixtures(fixture_lines(v))[0], ["file"])[0]


@query(
    "club_seasons",
    "L9",
    f"""WITH {FIX_SQL}, s AS (SELECT file, home AS club FROM fixed UNION SELECT file, away FROM fixed)
SELECT club, string_agg(file, ';' ORDER BY file) AS scopes FROM s GROUP BY club""",
)
def club_seasons(v):
    rows = L.fixture_scopes(L.parse_fixtures(fixture_lines(v))[0], ["file"])[1]
    return rows.select("club", F.array_join(F.transform("scopes", lambda s: s["file"]), ";").alias("scopes"))


CLUB_SQL = """cl AS (SELECT DISTINCT p_brand AS country, p_name AS alias, 'openfootball-club-' || substr(sha256(p_brand || chr(0) || p_name), 1, 20) AS club_id FROM part
 UNION SELECT p_brand, 'fc ' || p_size, 'openfootball-club-' || substr(sha256(p_brand || chr(0) || p_name), 1, 20) FROM part),
ix AS (SELECT country, alias, count(*) AS candidates, min(club_id) AS club_id FROM cl GROUP BY ALL)"""


def clubs(v):
    return L.merge_clubs(L.parse_clubs(club_lines(v))[0])


@query(
    "merged_clubs",
    "L7",
    f"""SELECT 'openfootball-club-' || substr(sha256(p_brand || chr(0) || p_name), 1, 20) AS club_id, p_brand AS country, count(*) AS rows,
 upper(p_name) IS NOT NULL AS named, count(DISTINCT p_size) + 1 AS aliases FROM part GROUP BY p_brand, p_name""",
)
def merged_clubs(v):
    return clubs(v).select(
        "club_id", "country", "rows", F.col("name").isNotNull().alias("named"),
        F.size("aliases").cast("bigint").alias("aliases"),
    )


@query("alias_index", "L5", f"WITH {CLUB_SQL} SELECT country, alias, candidates, club_id FROM ix")
def alias_index(v):
    return L.alias_index(clubs(v))


@query(
    "resolve_names",
    "L6",
    f"""WITH {CLUB_SQL}, w AS (SELECT DISTINCT p_brand AS country, CASE WHEN p_size % 3 = 0 THEN 'FC ' || p_size WHEN p_size % 3 = 1 THEN upper(p_name) ELSE 'Lost ' || p_size END AS name FROM part)
SELECT w.country, name, CASE WHEN candidates = 1 THEN club_id ELSE 'openfootball-club-' || substr(sha256(w.country || chr(0) || 'source' || chr(0) || lower(name)), 1, 20) END AS entity_id,
 CASE WHEN candidates = 1 THEN 'resolved' WHEN candidates > 1 THEN 'ambiguous' ELSE 'source' END AS status FROM w LEFT JOIN ix ON ix.country = w.country AND ix.alias = lower(name)""",
)
def resolve_names(v):
    size = F.col("p_size")
    name = (
        F.when(size % 3 == 0, F.concat(F.lit("FC "), size.cast("string")))
        .when(size % 3 == 1, F.upper("p_name"))
        .otherwise(F.concat(F.lit("Lost "), size.cast("string")))
    )
    names = v.table("part").select(F.col("p_brand").alias("country"), name.alias("name"))
    return L.resolve_names(names, L.alias_index(clubs(v)))


@query(
    "audit_clubs",
    "L11",
    f"""WITH {CLUB_SQL}, w AS (SELECT p_partkey, p_brand AS country, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'fc ' || p_size END AS name FROM part)
SELECT p_partkey, w.country, name, CASE WHEN candidates = 1 THEN 'verified' WHEN candidates > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status,
 CASE WHEN candidates = 1 THEN club_id END AS club_id FROM w LEFT JOIN ix ON ix.country = w.country AND ix.alias = name""",
)
def audit_clubs(v):
    size = F.col("p_size")
    rows = v.table("part").select(
        "p_partkey", F.col("p_brand").alias("country"),
        F.when(size % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("fc "), size.cast("string"))).alias("name"),
    )
    return L.audit_clubs(rows, L.alias_index(clubs(v)))


@query(
    "person_match",
    "L10",
    """WITH md AS (SELECT p_partkey AS person_id, 'Player ' || p_partkey % 900 AS name, make_date(1990, 1, CAST(1 + p_partkey % 25 AS INT)) AS dob, CAST(p_size % 3 AS VARCHAR) AS country, p_partkey % 40 = 0 AS bad FROM part),
pp AS (SELECT c_custkey, 'PLÁYER ' || c_custkey AS name, make_date(1990, 1, CAST(1 + c_custkey % 25 AS INT)) AS dob, CAST(c_nationkey % 3 AS VARCHAR) AS country FROM customer),
j AS (SELECT pp.c_custkey, count(md.person_id) AS options, count(md.person_id) FILTER (WHERE md.dob = pp.dob AND md.country = pp.country AND NOT bad) AS strong, min(md.person_id) AS id
  FROM pp LEFT JOIN md ON lower(md.name) = 'player ' || c_custkey GROUP BY pp.c_custkey)
SELECT c_custkey, options, CASE WHEN options = 1 AND strong = 1 THEN 'verified' WHEN options > 1 THEN 'ambiguous' WHEN options = 1 THEN 'likely' ELSE 'none' END AS status,
 CASE WHEN options = 1 AND strong = 1 THEN id END AS accepted_id FROM j""",
)
def person_match(v):
    day = lambda k: F.make_date(F.lit(1990), F.lit(1), (1 + F.col(k) % 25).cast("int"))
    metadata = v.table("part").select(
        F.col("p_partkey").alias("person_id"),
        F.concat(F.lit("Player "), (F.col("p_partkey") % 900).cast("string")).alias("name"),
        day("p_partkey").alias("dob"),
        (F.col("p_size") % 3).cast("string").alias("country"),
        (F.col("p_partkey") % 40 == 0).alias("conflicting"),
    )
    people = v.table("customer").select(
        "c_custkey",
        F.concat(F.lit("PLÁYER "), F.col("c_custkey").cast("string")).alias("name"),
        day("c_custkey").alias("dob"),
        (F.col("c_nationkey") % 3).cast("string").alias("country"),
    )
    return L.match_people(people, metadata).select("c_custkey", "options", "status", "accepted_id")


@query(
    "identity_rollup",
    "L12",
    """WITH r AS (SELECT c_mktsegment AS provider, o_custkey AS player_id, 'Name ' || o_custkey % 100 AS name, o_orderstatus AS team FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT provider, player_id, string_agg(DISTINCT name, ';' ORDER BY name) AS names, string_agg(DISTINCT team, ';' ORDER BY team) AS teams, min(name) AS f FROM r GROUP BY ALL)
SELECT provider, player_id, names, teams, count(*) OVER (PARTITION BY provider, f) > 1 AS common_name_review FROM m""",
)
def identity_rollup(v):
    rows = v.table("orders").join(v.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("provider"),
        F.col("o_custkey").alias("player_id"),
        F.concat(F.lit("Name "), (F.col("o_custkey") % 100).cast("string")).alias("name"),
        F.col("o_orderstatus").alias("team"),
        F.year("o_orderdate").alias("context"),
    )
    return L.identity_rollup(rows).select(
        "provider", "player_id", F.array_join("names", ";").alias("names"),
        F.array_join("teams", ";").alias("teams"), "common_name_review",
    )


@query(
    "identity_evidence",
    "L13",
    """WITH c AS (SELECT o_custkey AS p, o_orderkey AS k, o_orderkey % 2 = 0 AS nm, o_orderkey % 3 = 0 AS lb, o_orderkey % 5 < 2 AS dm, o_orderkey % 5 = 4 AS dc, o_orderkey % 7 < 4 AS ft,
   o_orderkey % 4 < 2 AS nat FROM orders),
j AS (SELECT p, count(*) AS candidates, count(*) FILTER (WHERE nm AND ft) AS credible, count(*) FILTER (WHERE nm AND ft AND dc) AS conflicted,
  count(*) FILTER (WHERE nm AND ft AND lb AND dm AND nat AND NOT dc) AS automatic, min(CASE WHEN nm AND ft AND lb AND dm AND nat AND NOT dc THEN k END) AS aid FROM c GROUP BY p),
f AS (SELECT c_custkey AS person_id, coalesce(candidates, 0) AS candidates, coalesce(credible, 0) AS credible, aid,
 CASE WHEN c_custkey % 50 = 0 THEN 'excluded' WHEN coalesce(credible, 0) > 1 OR conflicted > 0 THEN 'ambiguous'
  WHEN candidates = 1 AND credible = 1 AND automatic = 1 AND c_custkey % 9 <> 0 THEN 'verified' WHEN credible > 0 THEN 'likely' ELSE 'none' END AS status FROM customer LEFT JOIN j ON p = c_custkey)
SELECT person_id, candidates, credible, status, CASE WHEN status = 'verified' THEN aid END AS accepted_id FROM f""",
)
def identity_evidence(v):
    one = lambda *x: F.array(*[F.lit(i) for i in x])
    none = F.array().cast("array<string>")
    key = F.col("c_custkey")
    name = F.concat(F.lit("ana person"), key.cast("string"))
    people = v.table("customer").select(
        key.alias("person_id"), F.array(name).alias("names"), F.lit("1990-01-01").alias("dob"),
        one("spain").alias("nationalities"), one("club").alias("teams"), one("male").alias("genders"),
        (key % 9 == 0).alias("common_name_review"), F.lit(False).alias("strict_nationality"),
    )
    k = F.col("o_orderkey")
    own = F.concat(F.lit("ana person"), F.col("o_custkey").cast("string"))
    candidates = v.table("orders").select(
        F.col("o_custkey").alias("person_id"),
        k.alias("candidate_id"),
        F.when(k % 2 == 0, F.array(own)).otherwise(none).alias("names"),
        F.when(k % 3 == 0, own).otherwise(F.lit("someone else")).alias("label"),
        F.when(k % 5 < 2, one("1990-01-01")).when(k % 5 == 4, one("1991-01-01")).otherwise(none).alias("dobs"),
        (k % 7 < 4).alias("footballer"),
        F.when(k % 4 < 2, one("spain")).otherwise(none).alias("countries"),
        F.lit(False).alias("in_uk"),
        none.alias("clubs"),
        none.alias("genders"),
    )
    overrides = v.table("customer").where(key % 50 == 0).select(
        key.alias("person_id"), F.lit("excluded").alias("override_status"), F.lit(None).cast("bigint").alias("override_id")
    )
    return L.score_evidence(people, candidates, overrides)


@query(
    "people_by_country",
    "L14",
    "SELECT c_mktsegment AS country, count(*) AS people, CAST(sum(c_custkey) AS BIGINT) AS checksum FROM customer GROUP BY c_mktsegment",
)
def people_by_country(v):
    rows = v.table("customer").select(F.col("c_mktsegment").alias("country"), "c_custkey", "c_name")
    nested = L.group_by_country(rows, ["c_custkey", "c_name"])
    total = F.aggregate("people", F.lit(0).cast("bigint"), lambda a, p: a + p["c_custkey"])
    return nested.select("country", F.size("people").alias("n"), total.alias("s")).groupBy("country").agg(
        F.sum("n").alias("people"), F.sum("s").alias("checksum")
    )


# -- search ----------------------------------------------------------------------------


@query(
    "match_page",
    "M1",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40",
)
def match_page(v):
    rows = v.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return M.page(rows, ["o_orderdate", "o_orderkey"], 20, 40, o_orderstatus="F").select("o_orderkey", "o_custkey")


def directory(v):
    c = v.table("customer").join(v.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(
        v.table("region"), F.col("r_regionkey") == F.col("n_regionkey")
    )
    rows = c.select(
        F.col("c_custkey").alias("player_id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("competition"),
        F.col("c_mktsegment").alias("role_family"),
        F.array("c_nationkey").alias("teams"),
        F.col("c_acctbal").alias("minutes"),
        (F.col("c_custkey") % 3 == 0).alias("can_compare"),
    )
    return M.search_text(rows, ["name", "country", "competition"])


@query(
    "facet_search",
    "M2 M3",
    """SELECT c_custkey AS player_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'ASIA' AND c_mktsegment = 'MACHINERY' AND c_acctbal >= 500 AND c_custkey % 3 = 0 AND lower(c_name) LIKE '%customer%' AND lower(n_name) LIKE '%1%'""",
)
def facet_search(v):
    return M.facet_search(
        directory(v), "Asía nation_1 CUSTOMER", 500, ["can_compare"], role_family="MACHINERY", competition="ASIA"
    ).select("player_id")


@query(
    "club_search",
    "M5",
    "SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_3' AND lower(s_name) LIKE '%supplier%'",
)
def club_search(v):
    rows = v.table("supplier").join(v.table("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return M.facet_search(M.search_text(rows, ["s_name"]), "supplier", n_name="NATION_3").select("s_suppkey", "s_name")


@query(
    "federated_hits",
    "M4",
    """SELECT * FROM (SELECT 'player' AS kind, c_name AS label FROM customer WHERE c_name LIKE '%1%' ORDER BY c_name LIMIT 4) a
UNION ALL SELECT * FROM (SELECT 'team', s_name FROM supplier WHERE s_name LIKE '%1%' ORDER BY s_name LIMIT 2) b
UNION ALL SELECT * FROM (SELECT 'competition', n_name FROM nation WHERE n_name LIKE '%1%' ORDER BY n_name LIMIT 2) c""",
)
def federated_hits(v):
    kind = lambda t, c: M.search_text(v.table(t).select(F.col(c).alias("label")), ["label"])
    return M.federated_hits(
        {"player": (kind("customer", "c_name"), 4), "team": (kind("supplier", "s_name"), 2), "competition": (kind("nation", "n_name"), 2)},
        "1",
    )


@query(
    "prediction_lookup",
    "M6",
    "SELECT o_orderkey, 'supported' AS status FROM orders WHERE o_orderkey = 7 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7)",
)
def prediction_lookup(v):
    rows = v.table("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 1, "supported").otherwise("out_of_scope").alias("status")
    )
    return M.supported_prediction(rows, o_orderkey=7)


@query(
    "similar_lookup",
    "M7",
    f"WITH {Z_SQL} SELECT player_id, neighbour, rank FROM nn WHERE rank <= 5 AND player_id = (SELECT min(player_id) FROM co)",
    "co",
)
def similar_lookup(v):
    first = v.co.agg(F.min("player_id").alias("player_id"))
    near = S.nearest(scaled(v)[0], ["primary_role"], "player_id", 10, probes=first)
    return near.where(F.col("rank") <= 5).select(
        "player_id", "neighbour", F.col("rank").cast("bigint").alias("rank")
    )


FAMILY_CASE = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{g}'" for f, g in FAM.items()) + " END"


@query(
    "style_features",
    "M8",
    f"""WITH l AS ({" UNION ALL ".join(f"SELECT player_id, primary_role, '{c}' AS feature, {c} AS value FROM co" for c in RATES)}),
g AS (SELECT player_id, feature, {FAMILY_CASE} AS family, 100 * (rank() OVER (PARTITION BY primary_role, feature ORDER BY value) - 1
 + 0.5e0 * count(*) OVER (PARTITION BY primary_role, feature, value)) / count(*) OVER (PARTITION BY primary_role, feature) AS pct FROM l)
SELECT player_id, family, feature, round(pct, 6) AS percentile FROM (SELECT *, row_number() OVER (PARTITION BY player_id, family ORDER BY pct DESC, feature) AS r FROM g) q WHERE r <= 2""",
    "co",
)
def style_features(v):
    long = with_midrank(
        melt(v.co, ["player_id", "primary_role"], RATES), ["primary_role", "feature"], "value", "percentile"
    ).withColumn("family", F.element_at(F.create_map(*[F.lit(x) for p in FAM.items() for x in p]), F.col("feature")))
    return rounded(M.style_features(long, "player_id"), "percentile").select(
        "player_id", "family", "feature", "percentile"
    )


@query(
    "match_players",
    "M9",
    "SELECT DISTINCT player_id, team_id FROM lu JOIN customer ON c_custkey = player_id WHERE team_id = 3 AND lower(c_name) LIKE '%00003%'",
    "lu",
)
def match_players(v):
    names = v.table("customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"))
    rows = v.lu.select("player_id", "team_id").distinct().join(names, "player_id")
    return M.match_players(rows, "#00003", 3).select("player_id", "team_id")


@query(
    "club_fixtures",
    "M10",
    "SELECT o_orderkey AS fixture_id, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_custkey % 25 = 4 OR o_orderkey % 25 = 4 ORDER BY o_orderdate, o_orderkey LIMIT 80",
)
def club_fixtures(v):
    rows = v.table("orders").select(
        F.col("o_orderkey").alias("fixture_id"), F.to_date("o_orderdate").alias("date"),
        (F.col("o_custkey") % 25).alias("home"), (F.col("o_orderkey") % 25).alias("away"),
    )
    return M.club_fixtures(rows, 4).select("fixture_id", "date")
