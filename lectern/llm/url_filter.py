"""URL filtering by rules and by an empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host, registered domain and suffix. A beta-binomial prior is
fitted per level by the method of moments, and each level shrinks to the one above it: suffix to the
whole, domain to its suffix, host to its domain. A host is blocked when the lower bound of its
posterior for bad pages, the beta quantile at 1 - CERTAINTY, passes MAX_BAD; that is when the posterior
holds CERTAINTY beyond MAX_BAD, which a sum over the logit scale tells. Allow and block rules on host and path go before the verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, durable, table

#: The contract's rules: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of two labels under which names are registered; every other suffix is the last label.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au",
    "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg",
    "com.tr", "com.tw", "com.ua", "com.ve", "com.vn", "edu.au", "edu.cn", "edu.tw", "go.jp", "go.kr", "gob.mx", "gov.au", "gov.br", "gov.cn",
    "gov.in", "gov.uk", "gov.za", "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.au",
    "org.br", "org.cn", "org.in", "org.mx", "org.nz", "org.tw", "org.uk", "org.za",
)
MAX_BAD = 0.5
CERTAINTY = 0.95
MAX_STRENGTH = 1000.0
#: The sum goes over 2 * NODES + 1 cells; their width grows with the distance from the posterior's mode.
NODES, STEP = 120, 0.05


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end; path: from there to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; nulls where none fits. ``rules`` is a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer rules win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain (the suffix and one label more) and suffix, without a user or port; an address is its own domain."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    address = bare.rlike(r"^[0-9]+([.][0-9]+){3}$|^\[")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*SUFFIXES)
    domain = F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(address, F.lit("[]")).when(long, two).otherwise(F.substring_index(bare, ".", -1))


def mass_beyond(a: Column, b: Column, limit: float = MAX_BAD) -> Column:
    """The share of a beta distribution above ``limit``, by a sum over cells of the logit scale around its mode."""
    state = F.struct(a.alias("a"), b.alias("b"), F.log(a / b).alias("mode"), F.sqrt((a + b) / (a * b)).alias("scale"))

    def share(s: Column) -> Column:
        def cell(j: Column) -> Column:
            u = s["mode"] + s["scale"] * F.sinh(j * STEP)
            lo, hi = s["mode"] + s["scale"] * F.sinh((j - 0.5) * STEP), s["mode"] + s["scale"] * F.sinh((j + 0.5) * STEP)
            height = F.exp(s["a"] * (u - s["mode"]) - (s["a"] + s["b"]) * (F.log1p(F.exp(u)) - F.log1p(F.exp(s["mode"]))))
            beyond = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hi - F.lit(math.log(limit / (1 - limit)))) / (hi - lo)))
            return F.struct((height * (hi - lo)).alias("m"), (height * (hi - lo) * beyond).alias("x"))

        cells = F.transform(F.sequence(F.lit(-NODES), F.lit(NODES)), cell)
        zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("x"))
        sums = F.aggregate(cells, zero, lambda acc, c: F.struct((acc["m"] + c["m"]).alias("m"), (acc["x"] + c["x"]).alias("x")))
        return F.transform(F.array(sums), lambda t: t["x"] / t["m"])[0]

    return F.when(a <= 0, 0.0).when(b <= 0, 1.0).otherwise(F.transform(F.array(state), share)[0])


def _moments(counts: DataFrame) -> tuple[float, float]:
    """Mean and strength of a beta prior over the groups of ``counts`` (n, bad); three sums reach the driver."""
    n, bad, sq, groups = counts.agg(F.sum("n"), F.sum("bad"), F.sum(F.col("n").cast("double") * F.col("n")), F.count(F.lit(1))).first()
    if not n:
        return 0.0, MAX_STRENGTH
    m = bad / n
    spread = counts.agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.lit(m), 2))).first()[0]
    room = n - sq / n
    between = (spread - (groups - 1) * m * (1 - m)) / room if room > 0 else 0.0
    if between <= 0 or m in (0.0, 1.0):
        return m, MAX_STRENGTH
    return m, min(MAX_STRENGTH, max(1.0, m * (1 - m) / between - 1))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD) -> DataFrame:
    """One row per host: host, n, bad, posterior_mean, beyond (the posterior's share above ``max_bad``).

    ``hosts``: distinct host; ``outcomes``: host, bad (0 or 1, never null), one row per labelled page.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    by_host = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    by_host = durable(by_host.withColumns({"domain": domain, "suffix": suffix}), "url-hosts")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean, s_suffix = _moments(by_suffix)
    s_domain, s_host = _moments(by_domain)[1], _moments(by_host)[1]
    all_hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    zero = F.lit(0)

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.coalesce("bad", zero) + F.lit(strength) * prior) / (F.coalesce("n", zero) + F.lit(strength))

    suffixes = all_hosts.select("suffix").distinct().join(by_suffix, "suffix", "left").select("suffix", shrunk(F.lit(mean), s_suffix).alias("prior_suffix"))
    domains = (
        all_hosts.select("domain", "suffix").distinct().join(by_domain, ["domain", "suffix"], "left").join(suffixes, "suffix")
        .select("domain", shrunk(F.col("prior_suffix"), s_domain).alias("prior_domain"))
    )
    joined = all_hosts.join(by_host.select("host", "n", "bad"), "host", "left").join(domains, "domain")
    post, weight = shrunk(F.col("prior_domain"), s_host), F.coalesce("n", zero) + F.lit(s_host)
    return joined.select(
        "host", F.coalesce("n", zero).alias("n"), F.coalesce("bad", zero).alias("bad"), post.alias("posterior_mean"), mass_beyond(post * weight, (1 - post) * weight, max_bad).alias("beyond")
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bad: float = MAX_BAD, certainty: float = CERTAINTY) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, beyond.

    ``outcomes``: id, bad (0 or 1) of labelled pages; a null id or outcome says nothing, several
    outcomes of a page all count. A null url, or one without ``://``, has an empty host and path: a
    host of its own, judged by its pages' outcomes like any other. Repeated pages give repeated rows;
    an empty table gives none. With no outcomes at all every host is allowed. A host of a third of
    all rows is pre-aggregated before it is shuffled, and the join back to its pages can be split.
    """
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labelled = outcomes.select(F.col(id_col).alias("id"), "bad").filter("id IS NOT NULL AND bad IS NOT NULL")
    seen = judged.select("id", "host").join(labelled, "id").select("host", "bad")
    reputation = host_reputation(judged.select("host").distinct(), seen, max_bad)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = judged.join(reputation.select("host", "beyond"), "host", "left")
    own = F.when(F.col("beyond") >= certainty, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "beyond")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes by page: the label row of the same id; bad means low quality or toxic."""
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir)).drop("beyond")


SQL = rf"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), q AS (
  SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS bare FROM p
), k AS (
  SELECT page_id, host, path, CASE WHEN address THEN '[]' WHEN long THEN two ELSE split_part(bare, '.', -1) END AS suffix,
         CASE WHEN address OR NOT dotted THEN bare WHEN long AND array_length(string_split(bare, '.')) > 2 THEN split_part(bare, '.', -3) || '.' || two ELSE two END AS domain
  FROM (SELECT *, regexp_matches(bare, '^[0-9]+([.][0-9]+){{3}}$|^\[') AS address, strpos(bare, '.') > 0 AS dotted,
          split_part(bare, '.', -2) || '.' || split_part(bare, '.', -1) AS two, two IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) AS long FROM q)
), o AS (
  SELECT k.host, k.domain, k.suffix, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM k JOIN labels ON k.page_id = labels.doc_id
  WHERE quality IS NOT NULL OR toxic IS NOT NULL
), bh AS (SELECT host, domain, suffix, count(*) AS n, sum(bad) AS bad FROM o GROUP BY ALL),
bd AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM bh GROUP BY ALL),
bs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM bd GROUP BY ALL),
g AS (SELECT coalesce(sum(bad) / sum(n), 0) AS m FROM bs),
lv AS (SELECT 'h' AS l, n, bad FROM bh UNION ALL SELECT 'd', n, bad FROM bd UNION ALL SELECT 's', n, bad FROM bs),
mo AS (
  SELECT l, sum(n) AS t, count(*) AS c, sum(n * n) AS sq, sum(n * power(CAST(bad AS DOUBLE) / n - (SELECT m FROM g), 2)) AS sp FROM lv GROUP BY l
), st AS (
  SELECT l, CASE WHEN t - sq / t > 0 AND sp - (c - 1) * m * (1 - m) > 0 AND m NOT IN (0, 1)
    THEN least({MAX_STRENGTH}, greatest(1.0, m * (1 - m) / ((sp - (c - 1) * m * (1 - m)) / (t - sq / t)) - 1)) ELSE {MAX_STRENGTH} END AS s
  FROM mo, g
), ss AS (SELECT max(CASE WHEN l = 'h' THEN s END) AS sh, max(CASE WHEN l = 'd' THEN s END) AS sd, max(CASE WHEN l = 's' THEN s END) AS su FROM st),
h AS (SELECT DISTINCT host, domain, suffix FROM k),
r AS (
  SELECT h.host, coalesce(bh.n, 0) AS n, coalesce(bh.bad, 0) AS bad, coalesce(sh, {MAX_STRENGTH}) AS sh,
    (coalesce(bd.bad, 0) + coalesce(sd, {MAX_STRENGTH}) * ((coalesce(bs.bad, 0) + coalesce(su, {MAX_STRENGTH}) * m) / (coalesce(bs.n, 0) + coalesce(su, {MAX_STRENGTH}))))
      / (coalesce(bd.n, 0) + coalesce(sd, {MAX_STRENGTH})) AS prior
  FROM h LEFT JOIN bh ON h.host = bh.host LEFT JOIN bd ON h.domain = bd.domain AND h.suffix = bd.suffix LEFT JOIN bs ON h.suffix = bs.suffix, g, ss
), f AS (SELECT host, bad + sh * prior AS a, n + sh - (bad + sh * prior) AS b, ln(a / b) AS mode, sqrt((a + b) / (a * b)) AS scale FROM r),
c AS (
  SELECT host, a, b, mode, scale, mode + scale * (exp(j * {STEP}) - exp(-j * {STEP})) / 2 AS u, mode + scale * (exp((j - 0.5) * {STEP}) - exp((0.5 - j) * {STEP})) / 2 AS lo,
         mode + scale * (exp((j + 0.5) * {STEP}) - exp((-0.5 - j) * {STEP})) / 2 AS hi
  FROM f, range(-{NODES}, {NODES} + 1) AS t(j) WHERE a > 0 AND b > 0
), w AS (
  SELECT host, hi, (hi - lo) AS width, exp(a * (u - mode) - (a + b) * ((CASE WHEN u > 700 THEN u ELSE ln(1 + exp(least(u, 700))) END) - ln(1 + exp(mode)))) * (hi - lo) AS m FROM c
), b AS (
  SELECT host, sum(m * greatest(0, least(1, (hi - {math.log(MAX_BAD / (1 - MAX_BAD))}) / width))) / sum(m) AS beyond FROM w GROUP BY host
), g2 AS (SELECT f.host, CASE WHEN a <= 0 THEN 0 WHEN f.b <= 0 THEN 1 ELSE b.beyond END AS beyond FROM f LEFT JOIN b ON f.host = b.host),
v AS (
  SELECT k.page_id, k.host, k.path, CASE WHEN beyond >= {CERTAINTY} THEN 'block' ELSE 'allow' END AS own,
    CASE WHEN (k.host = 'example.org' OR k.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (k.host = 'example.org' OR k.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (k.host = 'com' OR k.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (k.host = 'com' OR k.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (k.host = 'org' OR k.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM k JOIN g2 ON k.host = g2.host
)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.org/en/1' THEN 'block' WHEN 'example.org/es/' THEN 'block' WHEN 'com/fr/' THEN 'allow' WHEN 'com/de/' THEN 'block' WHEN 'org/' THEN 'allow' ELSE own END AS verdict
FROM v
"""
QUERIES = {"op9_url_filter": op9_url_filter}
ORACLE = {"op9_url_filter": SQL}
