"""URL rules, and verdicts for all other pages from trust and distrust that spread over the links between hosts.

A rule is an action and a host with a path. It fits its host and all subdomains where the path of the url starts with
its own; of several the longest wins. Pages that no rule fits get the verdict of their host. Hosts with pages that an
allow rule fits are trusted seeds, hosts with pages that a block rule fits are blocked seeds, one unit a page. Trust
is a personalised PageRank from the trusted seeds along the links, distrust one from the blocked seeds against them:
who links to a blocked host is distrusted. Each round keeps the seed and takes 85 % of what the neighbours hold, dealt
evenly over their edges; this is PageRank with the mass of hosts without edges given back to the seeds, up to a factor.
A host is blocked if its distrust exceeds both its trust and ``least`` units for each of its pages.

Edges are distinct pairs of hosts, from absolute links in ``a`` elements; links within a host have no edge. Masses are
whole numbers (``UNIT`` to a page, floors go down), so that sums do not depend on their order; up to 10^10 pages they fit. Every
round is one join by host and one sum by host that tasks begin before the shuffle; a host with a third of all links
costs a skewed join that Spark splits. The state is written after every few rounds. Masses never shrink, so rounds that change none end the walk.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, and is allowed, as are hosts
that no mass reaches. Null html has no links. Ports and user names are part of the host as they stand. Repeated rows
give repeated results and count as pages each; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import stage

UNIT = 1_000_000
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
HOST, PATH = "://([^/?#]*)", "://[^/?#]*([^?#]*)"
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (action, rule); null if none does. Of equally long ones the one that sorts first."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def addressed(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id_col, host, path, action, rule)`` for each row of ``pages``."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), lowered(F.regexp_extract(url, HOST, 1)).alias("host"), F.regexp_extract(url, PATH, 1).alias("path"))
    fits = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return fits.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.action").alias("action"), F.col("_rule.rule").alias("rule"))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct ``(src, dst)``: a page of host ``src`` links to host ``dst``."""
    own = lowered(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), HOST, 1))
    found = F.array_distinct(F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(LINK), F.lit(1)))
    links = pages.select(own.alias("src"), F.explode(found).alias("dst")).withColumn("dst", lowered(F.col("dst")))
    return links.where("src != '' AND dst != '' AND src != dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = 20, block: int = 4) -> DataFrame:
    """``(kind, host, mass)`` after ``rounds`` rounds over ``edges (kind, src, dst)`` from ``seeds (kind, host, mass)``.

    Kinds do not mix: trust and distrust walk their own edges in the same joins. A share is floor(17 mass / (20 degree))."""
    degree = edges.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    dealt = stage(edges.join(degree, ["kind", "src"]).withColumnRenamed("src", "host"), "edges")
    seeds = stage(seeds, "seeds")
    state, before = seeds, None
    for done in range(0, rounds, block):
        for _ in range(min(block, rounds - done)):
            given = state.join(dealt, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.expr("(mass * 17) DIV (20 * degree)").alias("mass"))
            state = seeds.unionByName(given).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        state = stage(state, "masses")
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("kind", "host", "mass"))).first())
        if now == before:
            break
        before = now
    return state


def host_masses(pages: DataFrame, rules=RULES, rounds: int = 20, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, n_pages, trust, distrust)``, masses in units of ``UNIT``; hosts with neither pages nor mass are left out."""
    own = pages.select(F.lit(0).alias("_id"), F.col(f"`{url_col}`").alias("_url"))
    hosts = stage(addressed(own, rules, "_id", "_url").where("host != ''").groupBy("host").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("action") == "allow").alias("trust"), F.count_if(F.col("action") == "block").alias("distrust")), "hosts")
    links = stage(host_links(pages, url_col, html_col), "links")
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    seeds = [hosts.where(f"{k} > 0").select(F.lit(k).alias("kind"), "host", (F.col(k) * UNIT).alias("mass")) for k in ("trust", "distrust")]
    mass = spread(edges, seeds[0].union(seeds[1]), rounds).groupBy("host").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0)).alias(k) for k in ("trust", "distrust")])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return hosts.select("host", "n_pages").join(mass, "host", "full").select("host", zero("n_pages"), zero("trust"), zero("distrust"))


def judge(pages: DataFrame, rules=RULES, rounds: int = 20, least: float = 0.25, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: the id, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), and ``trust`` and
    ``distrust`` of the host."""
    masses = host_masses(pages, rules, rounds, url_col, html_col)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > F.lit(int(least * UNIT)) * F.col("n_pages"))
    found = addressed(pages, rules, id_col, url_col).join(masses.withColumn("_bad", bad), "host", "left")
    verdict = F.coalesce("action", F.when(F.col("_bad"), "block").otherwise("allow"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(id_col, "host", "path", "rule", verdict.alias("verdict"), zero("trust"), zero("distrust"))


def _sql(rounds: int = 20) -> str:
    """The SQL of the query: the same whole-number masses, one table expression per round."""
    def of(column: str) -> str:
        fits = []
        for action, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
            own, slash, rest = rule.partition("/")
            fits.append(f"WHEN (host = '{own}' OR host LIKE '%.{own}') AND starts_with(path, '{slash + rest}') THEN '{action if column == 'action' else rule}'")
        return f"CASE {' '.join(fits)} END"

    link = LINK.replace("'", "''")
    steps = ",\n".join(
        f"m{k} AS (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (SELECT kind, host, mass FROM m0 UNION ALL "
        f"SELECT e.kind, e.dst, (m.mass * 17) // (20 * e.degree) FROM m{k - 1} m JOIN edge e ON e.kind = m.kind AND e.src = m.host) GROUP BY kind, host)"
        for k in range(1, rounds + 1))
    return f"""WITH url AS MATERIALIZED (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages),
page AS MATERIALIZED (SELECT page_id, host, path, {of('action')} AS action, {of('rule')} AS rule FROM url),
host AS MATERIALIZED (SELECT host, count(*) AS n_pages, count(*) FILTER (action = 'allow') AS trust, count(*) FILTER (action = 'block') AS distrust
  FROM page WHERE host <> '' GROUP BY host),
link AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM url)
  WHERE src <> '' AND dst <> '' AND src <> dst),
way AS MATERIALIZED (SELECT 'trust' AS kind, src, dst FROM link UNION ALL SELECT 'distrust', dst, src FROM link),
edge AS MATERIALIZED (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree FROM way),
m0 AS MATERIALIZED (SELECT 'trust' AS kind, host, trust * {UNIT} AS mass FROM host WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust * {UNIT} FROM host WHERE distrust > 0),
{steps},
held AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) AS distrust FROM m{rounds} GROUP BY host)
SELECT p.page_id, p.host, p.path, p.rule,
  coalesce(p.action, CASE WHEN d.distrust > d.trust AND d.distrust > {UNIT // 4} * h.n_pages THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(d.trust, 0)::BIGINT AS trust, coalesce(d.distrust, 0)::BIGINT AS distrust
FROM page p LEFT JOIN host h ON h.host = p.host LEFT JOIN held d ON d.host = p.host"""


SQL = _sql()
