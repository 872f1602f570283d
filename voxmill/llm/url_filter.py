"""URL filter: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are summed by host, registered domain and public
suffix, which come from a table of suffix rules. The rate of bad pages of each suffix is shrunk towards that of all pages,
each domain's towards its suffix's, each host's towards its domain's, by
beta-binomial priors whose strength comes from the data: the intraclass correlation
by the method of moments at each level. A host is blocked when the lower bound of its
posterior rate is above ``most_bad``: few pages never suffice to block.

All on the DataFrame side. Outcomes are summed where they are before any shuffle, so
a host that holds a third of all pages is one row afterwards; the driver sees one
strength a level. Pages get their host's verdict by a join that can split a hot host.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule
and is allowed; pages with a null outcome don't count. Repeated rows count and are
judged each. Columns other than the id, the url and the outcome are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxmill.llm.common import Scratch, ascii_lower

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Suffixes of two labels; a short default, for which a full public table can be given.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "org.uk")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substr(url, F.instr(url, "://") + 3)
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    return F.when(there, ascii_lower(raw)).otherwise(""), F.when(there, path).otherwise("")


def suffix_table(spark: SparkSession, rules: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(rule): a suffix table from a list."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, rules))).alias("rule"))


def registered(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, suffix, domain) of distinct hosts: public suffix and registered domain by the longest rule that fits.

    suffixes: rule, lower case. ``co.uk`` is a suffix; ``*.ck`` makes every name under
    ck one; ``!www.ck`` takes a name out of that again, and wins. Without a rule the
    last label is the suffix. A host that is a suffix itself is its own domain. Hosts
    ask for the few rules that could fit them, and these are found by an equijoin.
    """
    labels = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")

    def asked(j: Column) -> Column:
        way = lambda key, size, out: F.struct(key.alias("rule"), out.alias("out"), size.alias("size"))
        star = F.concat(F.lit("*."), F.when(j > 1, last(j - 1)))  # null for one label
        return F.array(way(last(j), j, F.lit(False)), way(star, j, F.lit(False)), way(F.concat(F.lit("!"), last(j)), j - 1, F.lit(True)))

    ways = hosts.select("host", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), asked)))).where("rule is not null and size > 0")
    found = ways.join(suffixes.select("rule").distinct(), "rule").groupBy("host").agg(F.max(F.struct("out", "size"))["size"].alias("size"))
    size = F.coalesce("size", F.lit(1))
    return hosts.select("host").join(found, "host", "left").select("host", last(size).alias("suffix"), last(size + 1).alias("domain"))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F, F
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(what))
    return name, verdict


def page_outcome(html: Column) -> Column:
    """Weak label: 1 where over a twentieth of the visible characters are symbols, 0 else; null without text."""
    visible = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|&[a-z]+;|\s+", "")
    junk = F.length(F.regexp_replace(visible, r"[^#*$%&|!]+", ""))
    return F.when(F.length(visible) > 0, (junk * 20 > F.length(visible)).cast("int"))


def _strength(groups: DataFrame) -> float:
    """Prior observations of a level, from rows (n, bad, prior): k = 1 / rho - 1, rho the intraclass correlation around the prior."""
    v = F.col("prior") * (1 - F.col("prior"))
    got = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)),
        F.sum(v),
        F.sum(v * (F.col("n") - 1)),
    ).head()
    spread, chance, room = (float(x or 0.0) for x in got)
    rho = min(max((spread - chance) / room, 1e-4), 0.5) if room > 0 else 0.1
    return 1.0 / rho - 1.0


def reputation(pages: DataFrame, scratch: Scratch, suffixes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, spread): posterior mean and standard deviation of each host's rate of bad pages. pages: host, bad (0, 1 or null); suffixes: see ``registered``."""
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = scratch.table(hosts, "counts")
    hosts = scratch.table(hosts.join(registered(hosts, suffixes), "host").select("host", "domain", "suffix", "n", "bad"), "hosts")
    scratch.drop("counts")
    total = hosts.agg(F.sum("n"), F.sum("bad")).head()
    level = sums(hosts, "suffix").withColumn("prior", F.lit((float(total[1] or 0) + 0.5) / (float(total[0] or 0) + 1.0)))
    for name, below in (("suffix", sums(hosts, "domain", "suffix")), ("domain", hosts), ("host", None)):
        k = F.lit(_strength(level.where("n > 0")))
        a, n = k * F.col("prior") + F.col("bad"), k + F.col("n")
        mean = a / n
        if below is None:
            return level.select("host", "n", "bad", mean.alias("rate"), F.sqrt(mean * (1 - mean) / (n + 1)).alias("spread"))
        level = below.join(level.select(name, mean.alias("prior")), name)


def judge(pages: DataFrame, outcome: Column, rules=RULES, most_bad: float = 0.3, z: float = 1.645, page_id: str = "page_id", url: str = "url", suffixes: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per page: its id, ``host``, ``path``, ``rule``, ``verdict`` and the posterior of its host. suffixes: a table of suffix rules (``registered``); a short list without it."""
    scratch = scratch or Scratch(pages.sparkSession)
    host, path = host_and_path(pages[url].cast("string"))
    rows = scratch.table(pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"), outcome.alias("bad")), "pages")
    known = reputation(rows, scratch, suffix_table(pages.sparkSession) if suffixes is None else suffixes)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    bad_host = (F.col("host") != "") & (F.col("rate") - z * F.col("spread") > most_bad)
    return rows.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(bad_host, "block").otherwise("allow")).alias("verdict"), "rate", "spread")
