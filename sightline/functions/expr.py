"""Column expressions of coverage analytics. All are built-in functions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names, ranks and words of the report format.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
OTHER_RANK = 4
SEVERITY_WORDS = {"1": "low", "2": "low", "3": "medium", "4": "high", "5": "critical", "info": "low", "informational": "low", "low": "low", "medium": "medium", "high": "high", "critical": "critical"}
RISK_SCORES = {"critical": 99, "high": 73, "medium": 47, "low": 21}
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "H": 3600, "d": 86400, "w": 604800, "M": 2592000, "y": 31536000}
DEAD_LABELS = {"disconnected": "no matching source", "starved": "all matching sources stale or empty", "source-plan-incompatible": "source configuration is incompatible with this rule"}
IMPAIRED_LABELS = {"missing-fields": "required fields are missing", "lag-blind-window": "events may arrive too late for the rule", "selector-empty": "one input selector has no matching source", "source-plan-incompatible": "one or more sources are incompatible with this rule"}
CLASS_LABELS = {"dead-detection": "detection can't fire", "impaired-detection": "reduced visibility", "source-degraded": "source degraded", "volume-low": "low volume", "schema-drift": "schema changed", "unused-telemetry": "unused telemetry", "partial-input": "partial input"}
ERROR_WORDS = [
    ("timeout", ["timeout", "deadline exceeded", "timed out"]), ("authorization", ["403", "forbidden", "permission"]), ("authentication", ["401", "unauthorized", "authentication", "credential"]),
    ("TLS", ["tls", "x509", "certificate"]), ("connection", ["connection", "no such host", "dial tcp", "unreachable"]),
]


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key: Column, values: dict, default=None) -> Column:
    """The value of a small fixed map, or the default."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = pairs[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def wildcard_regex(pattern: Column) -> Column:
    """Anchored regular expression of a pattern in which ``*`` alone is special."""
    quoted = F.replace(c(pattern), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?s)\\A\\Q"), F.replace(quoted, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E\\z"))


def wildcard_match(pattern, name) -> Column:
    """Whether a name matches a pattern: all of it, case-sensitive."""
    return F.regexp_like(c(name), wildcard_regex(pattern))


def match_any(patterns, name) -> Column:
    """Whether any pattern of an array matches; false for none."""
    return F.exists(F.coalesce(c(patterns), F.array().cast("array<string>")), lambda p: wildcard_match(p, c(name)))


def parse_interval(text) -> Column:
    """Seconds of a whole number and a unit (s m h H d w M y); 0 if it isn't one."""
    text = c(text)
    whole = F.regexp_like(text, F.lit(r"\A\d{1,12}[smhHdwMy]\z"))
    n, unit = F.regexp_extract(text, r"\A(\d{1,12})", 1).try_cast("bigint"), F.substring(text, -1, 1)
    return F.coalesce(F.when(whole, n * lookup(unit, UNIT_SECONDS)), F.lit(0)).cast("bigint")


def parse_lookback(text) -> Column:
    """Seconds before now of ``now-<interval>[/round]``; 0 if it isn't one."""
    return parse_interval(F.regexp_extract(F.coalesce(c(text), F.lit("")), r"\Anow-([^/]*)(?:/.*)?\z", 1))


def parse_iso_duration(text) -> Column:
    """Seconds of ``PnDTnHnMnS``; null for years, months, weeks and anything else."""
    text = F.upper(F.trim(c(text)))
    number = r"(\d+(?:\.\d+)?)"
    valid = F.regexp_like(text, F.lit(rf"\AP(?=.*\d)(?:{number}D)?(?:T(?=\d)(?:{number}H)?(?:{number}M)?(?:{number}S)?)?\z"))
    part = lambda unit, lead: F.coalesce(F.regexp_extract(text, rf"{lead}{number}{unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(valid, part("D", "P") * 86400 + part("H", "T") * 3600 + part("M", "T(?:[0-9.]+H)?") * 60 + part("S", "T(?:[0-9.]+H)?(?:[0-9.]+M)?"))


def normalize_severity(text) -> Column:
    """critical, high, medium or low from words and 1 to 5 (also as floats); '' for anything else."""
    word = F.lower(F.trim(F.coalesce(c(text), F.lit(""))))
    number = word.try_cast("double")
    word = F.when(number.isNotNull() & (number == F.floor(number)) & number.between(1, 5), number.cast("int").cast("string")).otherwise(word)
    return lookup(word, SEVERITY_WORDS, "")


def rank_severity(severity) -> Column:
    return lookup(F.coalesce(c(severity), F.lit("")), SEVERITY_RANK, OTHER_RANK)


def detector_severity(triggers) -> Column:
    """The most severe of an array of severities; medium if none is known."""
    ranks = F.filter(F.transform(c(triggers), lambda s: rank_severity(normalize_severity(s))), lambda r: r < OTHER_RANK)
    return lookup(F.array_min(ranks), {rank: name for name, rank in SEVERITY_RANK.items()}, "medium")


def risk_score(severity, unknown: int = 47) -> Column:
    return lookup(F.coalesce(c(severity), F.lit("")), RISK_SCORES, unknown)


def epoch_or_rfc3339(text) -> Column:
    """Milliseconds of a number, a number as text, or an RFC 3339 time; null for anything else."""
    text = F.trim(c(text))
    number = F.when(F.regexp_like(text, F.lit(r"\A-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z")), text.try_cast("double").cast("bigint"))
    return F.coalesce(number, F.unix_millis(F.when(F.regexp_like(text, F.lit(r"\A\d{4}-\d\d-\d\d[Tt ]")), F.try_to_timestamp(text))))


def volume_bucket(ts) -> Column:
    """Weekday (0 is Sunday) and hour, such as 3:07."""
    return F.concat((F.dayofweek(c(ts)) - 1).cast("string"), F.lit(":"), F.lpad(F.hour(c(ts)).cast("string"), 2, "0"))


def catch_rate(lookback, lag, interval) -> Column:
    """Share of events a scheduled rule sees: (lookback - lag) / interval within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c(lookback) - c(lag)) / c(interval)))


def error_category(text) -> Column:
    """The first category whose words the error holds, else other."""
    low, out = F.lower(c(text)), F.lit("other")
    for name, words in reversed(ERROR_WORDS):
        out = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(name)).otherwise(out)
    return out


def clean_message(text, limit: int = 512) -> Column:
    """One line without terminal escapes, control and format characters, of at most ``limit`` characters."""
    text = F.regexp_replace(c(text), "(?:\x1b\\[|\x9b)[0-?]*[ -/]*[@-~]|(?:\x1b\\]|\x9d)[^\x07\x1b\x9c]*(?:\x07|\x1b\\\\|\x9c)?|\x1b[@-Z\\\\-_]", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", " "), r"\s+", " "))
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def resource_tail(path) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(F.rtrim(c(path), F.lit("/")), "/"), -1)


def version_detail(installed, current) -> Column:
    same = c(installed) == c(current)
    return F.when(same, F.format_string("installed %s; current", c(installed))).otherwise(F.format_string("installed %s; current %s", c(installed), c(current)))


def sorted_unique(values) -> Column:
    return F.array_sort(F.array_distinct(c(values)))


def first_non_empty(*values) -> Column:
    return F.coalesce(*[F.nullif(c(v), F.lit("")) for v in values], F.lit(""))


def quoted_join(values) -> Column:
    return F.array_join(F.transform(c(values), lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")


def reason_label(finding_class, reason) -> Column:
    """The human label of a finding's reason."""
    k, r = c(finding_class), c(reason)
    plain = F.replace(r, F.lit("-"), F.lit(" "))
    return (
        F.when(k == "dead-detection", F.coalesce(lookup(r, DEAD_LABELS), r))
        .when(k.isin("impaired-detection", "partial-input"), F.coalesce(lookup(r, IMPAIRED_LABELS), r))
        .when((k == "source-degraded") & (r == "stale"), "source is stale")
        .when((k == "source-degraded") & (r == "empty"), "source has no events")
        .when(k == "volume-low", "volume is below its baseline")
        .when(k == "schema-drift", "field schema changed")
        .when(k == "unused-telemetry", "no enabled detection uses this source")
        .otherwise(plain)
    )


def class_label(finding_class) -> Column:
    k = c(finding_class)
    return F.coalesce(lookup(k, CLASS_LABELS), F.replace(k, F.lit("-"), F.lit(" ")))


def finding_id(target, instance, backend, finding_class, rule, reason, source, dependency) -> Column:
    """Stable id: 20 hex digits of the SHA-256 of the parts joined by NUL."""
    parts = [F.coalesce(c(x), F.lit("")) for x in (target, instance, backend, finding_class, rule, reason, source, dependency)]
    return F.concat(F.lit("finding-"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 20))


def short_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(text, 256), 1, 20))


def scope_id(mode, configuration, schema_tracking, stateful, include, exclude, candidates) -> Column:
    """Identity of a scan's scope; the order of its lists doesn't matter."""
    flag = lambda name, on: F.concat(F.lit(name + "="), c(on).cast("int").cast("string"))
    listed = lambda name, values: F.transform(F.array_sort(c(values)), lambda v: F.concat(F.lit(name + "="), v))
    head = F.array(c(mode), c(configuration), flag("schema", schema_tracking), flag("stateful", stateful))
    return short_id("scope", F.array_join(F.concat(head, listed("include", include), listed("exclude", exclude), listed("candidate", candidates)), "\0"))


def target_id(backend, *parts) -> Column:
    """Identity of what is scanned: the backend and its addresses, without credentials, query or fragment."""

    def plain(part):
        part = F.rtrim(F.trim(c(part)), F.lit("/"))
        url = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?#]*@)?([^/@?#]+)([^?#]*).*$"
        piece = lambda n: F.regexp_extract(part, url, n)
        return F.when(F.regexp_like(part, F.lit(url)), F.rtrim(F.concat(F.lower(piece(1)), F.lit("://"), F.lower(piece(2)), piece(3)), F.lit("/"))).otherwise(part)

    return short_id("target", F.concat_ws("\0", F.lower(F.trim(c(backend))), *[plain(p) for p in parts]))


def configuration_id(settings: dict[str, Column]) -> Column:
    """Identity of the settings that change what a scan finds, as lines of name=value."""
    return short_id("config", F.concat(*[F.concat(F.lit(name + "="), F.coalesce(v.cast("string"), F.lit("none")), F.lit("\n")) for name, v in settings.items()]))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column, from two nested digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def pseudonym(prefix: str, key: bytes, value) -> Column:
    """``prefix-`` and 12 hex digits for a value; a pseudonym already, null and '' stay."""
    if len(key) < 32:
        raise ValueError("the key must have at least 32 bytes")
    value = c(value)
    made = F.concat(F.lit(prefix + "-"), F.substring(hmac_sha256(key, F.concat(F.lit(prefix.encode() + b"\0"), value.cast("binary"))), 1, 12))
    kept = F.regexp_like(value, F.lit(rf"\A{prefix}-[0-9a-f]{{12}}\z"))
    return F.when(value.isNull() | (value == "") | kept, value).otherwise(made)


def redact(df, prefixes: dict[str, str], key: bytes):
    """Replace the named columns by pseudonyms; array columns element by element."""
    kinds = dict(df.dtypes)

    def hidden(col, prefix):
        return F.transform(col, lambda v: pseudonym(prefix, key, v)) if kinds[col].startswith("array") else pseudonym(prefix, key, col)

    return df.withColumns({col: hidden(col, prefix) for col, prefix in prefixes.items()})
