"""URL filters by host reputation, with written rules before it.

Reputation is empirical Bayes: the share of bad pages of a host is drawn towards that of its registered
domain, which is drawn towards that of its suffix, and that towards all pages, each through a beta prior
whose weight is estimated from the spread of the level below. A host is blocked if even the lower bound of
its posterior exceeds the tolerated share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host (with all its subdomains) and the start of a path; allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A to Z lower-cased; empty for null or no "://"."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Suffixes of more than one label under which domains are registered, and hosting domains whose
#: subdomains belong to different owners. A parameter everywhere; one label is a suffix without being listed.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "com.ar",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "example.com", "example.org", "example.net",
)
#: What stands before a host proper, and after it.
_AROUND = r"^[^@]*@|:[0-9]*$"
_ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$"


def plain(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(host, _AROUND, "")


def listed(suffixes: tuple[str, ...]) -> str:
    return "|".join(s.replace(".", "\\.") for s in suffixes)


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the longest listed suffix with the label before it, else the last two labels; an address or a
    name of one label is its own."""
    host = plain(host)
    under = F.regexp_extract(host, rf"([^.]+\.(?:{listed(suffixes)}))$", 1)
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(host.rlike(_ADDRESS), host).when(under != "", under).when(two != "", two).otherwise(host)


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """What stands after the first label of the registered domain; an address has none."""
    host = plain(host)
    under = F.regexp_extract(host, rf"[^.]+\.({listed(suffixes)})$", 1)
    return F.when(host.rlike(_ADDRESS), "").when(under != "", under).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


#: Suffix rules up to this many are broadcast; beyond it they are joined by shuffle.
FEW_RULES = 100_000


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """tail, kind of the rules in a file of public suffixes: a rule a line, up to its first white space; lines that are empty or begin with
    "//" are none. kind: 0 the tail itself, 1 any label before it ("*."), 2 an exception ("!"). Repeated rules count once."""
    line = F.translate(F.regexp_extract("value", r"^\s*(\S*)", 1), UPPER, LOWER)
    rows = spark.read.text(path).select(line.alias("r")).filter("r <> '' and not startswith(r, '//')")
    kind = F.when(F.col("r").startswith("!"), 2).when(F.col("r").startswith("*."), 1).otherwise(0)
    return rows.select(F.regexp_replace("r", r"^(!|\*\.|\.)", "").alias("tail"), kind.alias("kind")).distinct()


def with_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host, ...) with domain and suffix by rules (see read_suffixes): an exception decides, else the rule of the most labels, else the
    last label; the domain has one label more. A host that is a suffix itself, an address and a name of one label are their own domain."""
    names = hosts.select("host").distinct().withColumn("_l", F.split(plain(F.col("host")), r"\."))
    tails = names.select("host", "_l", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.array_join(F.slice("_l", i, F.size("_l")), "."))).alias("_i", "tail"))
    near = F.broadcast(rules) if rules.count() <= FEW_RULES else rules
    start = F.col("_i") - F.when(F.col("kind") == 1, 1).when(F.col("kind") == 2, -1).otherwise(0)
    fits = tails.join(near, "tail").withColumn("_s", start).filter("_s >= 0").groupBy("host").agg(F.min(F.struct((F.col("kind") != 2).alias("k"), F.col("_s").alias("s"))).alias("_b"))
    rows = names.join(fits, "host", "left").withColumn("_n", F.size("_l"))
    at = F.least(F.greatest(F.coalesce(F.col("_b.s"), F.col("_n") - 1), F.lit(1)), F.greatest(F.col("_n") - 1, F.lit(1)))
    rest = lambda k: F.array_join(F.slice("_l", k + 1, F.col("_n")), ".")
    address = plain(F.col("host")).rlike(_ADDRESS)
    domain = F.when(address | (F.col("_n") == 1), plain(F.col("host"))).otherwise(rest(at - 1))
    suffix = F.when(address, "").when(F.col("_n") == 1, plain(F.col("host"))).otherwise(rest(at))
    return hosts.join(rows.select("host", domain.alias("domain"), suffix.alias("suffix")), "host")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The name of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def _weight(n: str, bad: str, rate: Column) -> Column:
    """Weight of a beta prior with mean `rate` whose beta-binomial spread over groups of (n, bad) equals the one seen.

    By moments over groups of two or more: sum (bad - n rate)^2 = rate (1 - rate) sum n (1 + (n - 1) rho),
    weight = (1 - rho) / rho, kept within 1 and 1000; without groups of two it is 10."""
    seen = F.sum(F.when(F.col(n) > 1, F.pow(F.col(bad) - F.col(n) * rate, 2)))
    base = F.sum(F.when(F.col(n) > 1, rate * (1 - rate) * F.col(n)))
    more = F.sum(F.when(F.col(n) > 1, rate * (1 - rate) * F.col(n) * (F.col(n) - 1)))
    rho = F.try_divide(seen - base, more)
    found = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.when(rho <= 0.001, 999.0).otherwise(F.try_divide(1 - rho, rho))))
    return F.when(rho.isNull(), 10.0).otherwise(found)


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """host, n, bad, posterior, lower: of each host of labelled pages (columns url, page_id; outcomes: page_id, bad 0/1).

    The levels host, registered domain and suffix are sums of sums, so a host with a third of all pages is
    added up where it is read. Lower: mean less z standard deviations of the beta posterior.
    """
    labelled = pages.select("page_id", host_of(F.col("url")).alias("host")).join(outcomes, "page_id")
    hosts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("bigint").alias("bad"))
    return shrink(Scratch(pages.sparkSession, "hosts").keep(hosts, "counts"), z, suffixes)


def shrink(hosts: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """The posterior of each host from its counts (host, n, bad). Of the whole table only a few numbers come to the driver.

    suffixes: names, or a table of rules as read_suffixes() gives it. Hosts are to be there once and not null; an empty table gives an empty result."""
    if isinstance(suffixes, DataFrame):
        hosts = with_domains(hosts, suffixes)
    else:
        hosts = hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    overall, total = suffixes.agg(F.coalesce((F.sum("sbad") + 1) / (F.sum("sn") + 2), F.lit(0.5)), F.coalesce(F.sum("sn"), F.lit(0))).first()
    overall = F.lit(float(overall))
    # a prior weighs no more than the pages it was drawn from
    ws = F.lit(float(min(suffixes.agg(_weight("sn", "sbad", overall)).first()[0], total + 2)))
    suffixes = suffixes.select("suffix", ((F.col("sbad") + ws * overall) / (F.col("sn") + ws)).alias("smean"), (F.col("sn") + ws).alias("behind"))
    domains = domains.join(suffixes, "suffix")
    wd = F.least(F.lit(domains.agg(_weight("dn", "dbad", F.col("smean"))).first()[0]), F.col("behind"))
    domains = domains.select("domain", ((F.col("dbad") + wd * F.col("smean")) / (F.col("dn") + wd)).alias("dmean"), (F.col("dn") + wd).alias("behind"))
    hosts = hosts.join(domains, "domain")
    wh = F.least(F.lit(hosts.agg(_weight("n", "bad", F.col("dmean"))).first()[0]), F.col("behind"))
    a, b = F.col("bad") + wh * F.col("dmean"), F.col("n") - F.col("bad") + wh * (1 - F.col("dmean"))
    mean = a / (a + b)
    return hosts.select("host", "n", "bad", mean.alias("posterior"), (mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], tolerated: float = 0.4, z: float = 1.645, suffixes: tuple[str, ...] | DataFrame = SUFFIXES, salts: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; allow or block.

    The longest fitting rule decides; without one, a host is blocked if the lower bound of its posterior share
    of bad pages exceeds `tolerated`, and a host without labelled pages is allowed. Null urls, and urls without
    "://", have an empty host and path. Repeated rows stay repeated; labels of a page are averaged and count as
    bad at a half or more; other columns are ignored; an empty table gives an empty result. Pages meet the blocked hosts
    by host and one of `salts` numbers, so the pages of a frequent host spread over as many tasks.
    """
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    outcomes = outcomes.groupBy("page_id").agg((F.avg("bad") >= 0.5).cast("int").alias("bad")).filter("bad is not null")
    blocked = reputations(pages, outcomes, z, suffixes).filter(F.col("lower") > tolerated).select("host", F.lit(True).alias("blocked"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for r in rules:
        ruled = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(ruled)
    seen = seen.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    return seen.join(blocked, ["host", "_salt"], "left").select("page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict"))
