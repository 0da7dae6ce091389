"""URL filtering by rules and by empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host. Each level's rate is a beta distribution whose prior comes
from the level above: suffixes shrink towards the corpus, registered domains towards their suffix, hosts towards their
domain. A prior's mean is the posterior mean above it and its strength is fitted by moments: the between-group variance
of beta-binomial rates gives the number of pseudo-pages. A host is blocked where its posterior leaves no more than TAIL for
rates up to the limit, that is, where the beta distribution's lower quantile is over the limit. So a few bad pages
alone condemn nobody, and a host that nobody has labelled has the verdict of its domain or suffix, with that level's uncertainty.

Outcomes are counted by host once, into a written table that each level rolls up from the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: (verdict, host, path). The longest rule that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LIMIT = 0.25
#: Posterior chance of a rate up to the limit, beyond which nothing is blocked; and the normal quantile of it.
TAIL, Z = 0.05, 1.6448536269514722
#: Second labels that, under a country's two letters, are part of the public suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "govt", "ltd", "ne", "net", "nom", "or", "org", "plc", "sch")
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"
#: Terms of the continued fraction; pages up to which it is used (beyond, an expansion that is then closer than it).
TERMS, FRACTION_UP_TO = 200, 5000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    slash = F.instr(rest, "/")
    return F.when(slash > 0, rest.substr(slash, F.length(rest))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + F.lit(3), F.length(url))), F.lit(""))


def bare_host(host: Column) -> Column:
    """The host without user, port and closing dot; what reputations go by."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", ""), r"\.+$", "")


def _two_labels(bare: Column) -> Column:
    return F.substring_index(bare, ".", -2).rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")


def domain_of(bare: Column) -> Column:
    """The registered domain: a label more than the suffix. Addresses are domains of their own."""
    return F.when(bare.rlike(ADDRESS), bare).when(_two_labels(bare), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def suffix_of(bare: Column) -> Column:
    """The public suffix: the last label, or the last two by SECOND_LEVEL. Addresses share one."""
    return F.when(bare.rlike(ADDRESS), "(address)").when(_two_labels(bare), F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equal lengths the first given."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rhost, rpath in sorted(rules, key=lambda r: len(r[1] + r[2])):
        own = (host == F.lit(rhost)) | host.endswith("." + rhost)
        out = F.when(own & path.startswith(rpath), F.struct(F.lit(rhost + rpath).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """Of ``groups(n, k, m)``, the pseudo-pages that a prior of this level is worth, by moments.

    With rates p = k / n around their prior means m: E[sum n (p - m)^2] = sum m(1-m) (1 + (n-1) rho), where rho =
    1 / (strength + 1).
    """
    m, n, k = F.col("m"), F.col("n").cast("double"), F.col("k").cast("double")
    v = m * (1 - m)
    r = groups.agg(F.sum(n * (k / n - m) * (k / n - m)).alias("s"), F.sum(v).alias("v"), F.sum(v * (n - 1)).alias("w")).first()
    rho = (r.s - r.v) / r.w if r.w else 0.0
    return round(max(least, min(most, 1 / rho - 1)) if rho > 0 else most, 6)


def _posterior(groups: DataFrame, strength: float) -> DataFrame:
    """Adds the posterior's a and b to ``groups(n, k, m)``."""
    a, b = F.col("k") + F.col("m") * F.lit(strength), F.col("n") - F.col("k") + (1 - F.col("m")) * F.lit(strength)
    return groups.withColumns({"a": a, "b": b})


def reputations(labelled: DataFrame) -> tuple[tuple[float, float], dict[str, DataFrame]]:
    """``labelled(host, bad)`` to posteriors: (a, b) of the corpus, and a table (level, a, b) of each level.

    ``host`` is bare. Three numbers, the strengths, come to the driver; the tables are written.
    """
    hosts = labelled.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    hosts = staged(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    corpus = float(total.k + 1), float(total.n - total.k + 1)
    domains = staged(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(corpus[0] / sum(corpus)))
    out, above = {}, None
    for level, groups in (("suffix", suffixes), ("domain", domains), ("host", hosts.drop("suffix"))):
        if above is not None:
            groups = groups.join(out[above].select(above, (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), above)
        groups = staged(groups, level)
        out[level] = _posterior(groups, _strength(groups)).select(level, "a", "b")
        above = level
    return corpus, out


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    rising = x
    for i in range(1, 8):
        rising = rising * (x + i)
    return series - F.log(rising)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""

    def term(h: Column, c: Column, d: Column, f: Column) -> tuple[Column, Column, Column]:
        d = 1 / (1 + f * d)
        c = 1 + f / c
        return h * d * c, c, d

    def two(state: Column, m: Column) -> Column:
        m2 = 2 * m
        h, c, d = term(state["h"], state["c"], state["d"], m * (b - m) * x / ((a + m2 - 1) * (a + m2)))
        even = F.struct(h.alias("h"), c.alias("c"), d.alias("d"))
        return F.transform(F.array(even), lambda s: F.struct(*(v.alias(n) for n, v in zip("hcd", term(s["h"], s["c"], s["d"], -(a + m) * (a + b + m) * x / ((a + m2) * (a + m2 + 1)))))))[0]

    d0 = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(d0.alias("h"), F.lit(1.0).alias("c"), d0.alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, lambda s, m: two(s, m.cast("double")))["h"]


def chance_up_to(limit: float, a: Column, b: Column, z: float = Z) -> Column:
    """P(rate <= limit) of a beta(a, b); of those over FRACTION_UP_TO pages, on which side of the tail's chance it is.

    Beyond that number the quantile by the expansion of Abramowitz and Stegun 26.5.22 is compared with the limit.
    """
    x = F.lit(limit)
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    left = x < (a + 1) / (a + b + 2)
    p, q, y = F.when(left, a).otherwise(b), F.when(left, b).otherwise(a), F.when(left, x).otherwise(1 - x)
    part = front * _fraction(p, q, y) / p
    exact = F.when(left, part).otherwise(1 - part)
    ra, rb, lam = 1 / (2 * a - 1), 1 / (2 * b - 1), (z * z - 3) / 6
    h = 2 / (ra + rb)
    w = F.lit(z) * F.sqrt(h + lam) / h - (rb - ra) * (lam + 5 / 6 - 2 / (3 * h))
    low = a / (a + b * F.exp(2 * w))
    return F.when(a + b <= FRACTION_UP_TO, exact).when((a > 1) & (b > 1), F.when(low > x, 0.0).otherwise(1.0)).otherwise(F.when(a / (a + b) > x, 0.0).otherwise(1.0))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, chance_clean: one row for each row of ``pages``.

    ``labels(page_id, bad)``: outcomes; null outcomes and ids are left out, an id labelled more than once counts each
    time. ``chance_clean`` is the posterior chance that the host's rate is within the limit. A null url, or one without
    ``://``, has an empty host and path; the empty host has a reputation like any other. Without labels the corpus prior is
    even and its chance decides. Repeated rows get equal verdicts. Empty pages give an empty result; other columns are ignored.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("bare", bare_host(F.col("host")))
    known = labels.select(F.col("page_id").cast("long").alias("page_id"), "bad").join(p.select("page_id", F.col("bare").alias("host")), "page_id").select("host", "bad")
    corpus, rep = reputations(known)
    hosts = p.select("bare").distinct().withColumns({"domain": domain_of(F.col("bare")), "suffix": suffix_of(F.col("bare"))})
    for level, key in (("host", "bare"), ("domain", "domain"), ("suffix", "suffix")):
        table = rep[level].select(F.col(level).alias(key), F.struct("a", "b").alias(f"{level}_ab"))
        hosts = hosts.join(table, key, "left")
    even = F.struct(F.lit(corpus[0]).alias("a"), F.lit(corpus[1]).alias("b"))
    judged = hosts.select("bare", F.coalesce("host_ab", "domain_ab", "suffix_ab", even).alias("ab"))
    judged = staged(judged.select("bare", chance_up_to(limit, F.col("ab.a"), F.col("ab.b")).alias("chance_clean")), "judged")
    out = p.join(judged, "bare").withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("chance_clean") <= F.lit(TAIL), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "chance_clean")
