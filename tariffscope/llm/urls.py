"""URL filter: rules by host and path, and a reputation of hosts learned from labelled pages.

A page's outcome is bad or not. Bad rates of hosts are shrunk through beta-binomial priors: every
page, then suffix, registered domain, and host, each the prior mean of the next. How closely
the members of a level follow the level above, the prior's strength, is estimated by moments from
all members. A host is blocked if the lower bound of its posterior bad rate, mean less ``z``
standard deviations, exceeds ``excess`` times the rate of all pages. A rule that fits a url comes before its host's reputation.

Rows per host are summed inside the tasks before they are shuffled, so a host with a third
of all pages is no larger than another; its pages meet its verdict in a join that adaptive
execution splits.

Defined results: a null url or one without ``://`` has an empty host and path, and is judged as
that host; hosts without labelled pages take their domain's rate, domains their suffix's;
labels with a null id or outcome are not outcomes; each of an id's repeated labels counts once, and
for each of its pages; repeated pages are each judged; with no labels at all every rate is 1/2,
so nothing is blocked; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Suffixes of two labels under which names are registered.
DOUBLE_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.uk",
)
EXCESS, Z = 1.25, 1.2815515655446004
# Least and largest intraclass correlation a level is credited with; strength is 1 / rho - 1.
RHO = (1e-4, 0.5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    parts = "://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, its port left out."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    last = [F.regexp_extract(name, r"([^.]*" + r"\.[^.]*" * n + ")$", 1) for n in range(3)]
    double = last[1].isin(*DOUBLE_SUFFIXES)
    domain = F.when(double, last[2]).otherwise(last[1])
    return F.when(domain == "", name).otherwise(domain), F.when(double, last[1]).otherwise(last[0])


def matching_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null."""
    text = verdict = F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, decision).otherwise(verdict)
    return text, verdict


def _strength(members: DataFrame) -> Column:
    """How many outcomes the prior of ``members`` (n, bad, prior) is worth, a one-row subquery."""
    spread = F.col("prior") * (1 - F.col("prior"))
    off = F.col("bad") - F.col("n") * F.col("prior")
    over = F.sum(off * off - F.col("n") * spread)
    of = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    rho = F.when(of > 0, over / of).otherwise(RHO[1])
    return members.select((1 / F.least(F.greatest(rho, F.lit(RHO[0])), F.lit(RHO[1])) - 1).alias("s")).scalar()


def _level(members: DataFrame, parents: DataFrame | None, parent: str) -> DataFrame:
    """``members`` with their parent's rate as ``prior``, the prior's strength, and their own rate."""
    if parents is None:
        total = members.select(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("rate")).scalar()
        members = members.withColumn("prior", F.coalesce(total, F.lit(0.5)))
    else:
        members = members.join(parents.select(parent, F.col("rate").alias("prior")), parent)
    members = members.withColumn("strength", _strength(members))
    return members.withColumn(
        "rate", (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))
    )


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Each host's outcomes, posterior mean of its bad rate, standard deviation, and the rate of all pages.

    ``pages`` (page_id, host), ``labels`` (page_id, bad).
    """
    scratch = Scratch(pages.sparkSession, "urls")
    outcomes = (
        labels.select("page_id", F.col("bad").cast("long").alias("bad"))
        .where("page_id is not null and bad is not null")
        .groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    )
    known = pages.join(outcomes, "page_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = pages.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domain, suffix = domain_and_suffix(F.col("host"))
    # Each level is stored once and read by the next.
    hosts = scratch.keep(
        every.unionByName(known).groupBy("host").agg(*sums)
        .withColumns({"domain": domain, "suffix": suffix}), "hosts",
    )
    domains = scratch.keep(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = scratch.keep(_level(domains.groupBy("suffix").agg(*sums), None, ""), "suffix_rates")
    domains = scratch.keep(_level(domains, suffixes, "suffix"), "domain_rates")
    hosts = _level(hosts, domains, "domain")
    rate = F.col("rate")
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + F.col("strength") + 1))
    overall = suffixes.select(F.max("prior")).scalar()
    return hosts.select(
        "host", "domain", "suffix", "n", "bad", "rate", deviation.alias("deviation"), overall.alias("overall")
    )


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, excess: float = EXCESS, z: float = Z) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    host, path = host_and_path("url")
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    bound = F.col("rate") - z * F.col("deviation")
    verdicts = host_reputation(parsed.select("page_id", "host"), labels).select(
        "host", F.when(bound > excess * F.col("overall"), "block").otherwise("allow").alias("reputation")
    )
    text, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    return parsed.join(verdicts, "host").select(
        "page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, "reputation").alias("verdict")
    )


ORACLE = """
with parsed as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path
  from pages),
outcomes as (
  select doc_id as page_id, count(*) as n, count(*) filter (where quality = 0) as bad
  from labels where doc_id is not null and quality is not null group by 1),
names as (
  select host, regexp_replace(host, ':[0-9]*$', '') as name, coalesce(sum(n), 0) as n, coalesce(sum(bad), 0) as bad
  from parsed left join outcomes using (page_id) group by 1),
cuts as (
  select *, regexp_extract(name, '([^.]*)$', 1) as one, regexp_extract(name, '([^.]*\\.[^.]*)$', 1) as two,
    regexp_extract(name, '([^.]*\\.[^.]*\\.[^.]*)$', 1) as three
  from names),
hosts as (
  select host, n, bad, case when two in ({double}) then two else one end as suffix,
    coalesce(nullif(case when two in ({double}) then three else two end, ''), name) as domain
  from cuts),
d0 as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by 1, 2),
s0 as (select suffix, sum(n) as n, sum(bad) as bad from d0 group by 1),
s1 as (select *, (select (sum(bad) + 1) / (sum(n) + 2) from s0) as prior from s0),
s2 as (select *, (bad + {s1} * prior) / (n + {s1}) as rate from s1),
d1 as (select d0.*, s2.rate as prior from d0 join s2 using (suffix)),
d2 as (select *, (bad + {d1} * prior) / (n + {d1}) as rate from d1),
h1 as (select hosts.*, d2.rate as prior from hosts join d2 using (domain)),
h2 as (select *, {h1} as strength from h1),
h3 as (select host, n, strength, (bad + strength * prior) / (n + strength) as rate from h2),
judged as (
  select host, case when rate - {z} * sqrt(rate * (1 - rate) / (n + strength + 1)) > {excess} * (select max(prior) from s1)
    then 'block' else 'allow' end as reputation from h3),
ruled as (
  select page_id, host, path, reputation, case
    when (host = 'www.example.com' or suffix(host, '.www.example.com')) and prefix(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/en/') then 'example.com/en/'
    when (host = 'net' or suffix(host, '.net')) and prefix(path, '/es/') then 'net/es/'
    when (host = 'net' or suffix(host, '.net')) and prefix(path, '/fr/') then 'net/fr/'
    when (host = 'com' or suffix(host, '.com')) and prefix(path, '/') then 'com/' end as rule
  from parsed join judged using (host))
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow'
  when rule is not null then 'block' else reputation end as verdict
from ruled
"""


def oracle() -> str:
    strength = (
        "(select 1 / least(greatest(case when sum(n * (n - 1) * prior * (1 - prior)) > 0 then"
        " sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior))"
        " else 0.5 end, 1e-4), 0.5) - 1 from {0})"
    )
    return ORACLE.format(
        double=", ".join(f"'{s}'" for s in DOUBLE_SUFFIXES), z=Z, excess=EXCESS,
        **{level: strength.format(level) for level in ("s1", "d1", "h1")},
    )
