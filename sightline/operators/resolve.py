"""Rules to sources: selectors, wildcard edges, aliases, statuses.

rules: rule_id, name, enabled, severity, patterns (array). sources: source, docs, last_event.
Wildcards are matched on distinct patterns and distinct names only, by an equality join on parts of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import wildcard_match


#: Characters of a name's beginning or end, and of a piece inside, that names are found by.
ENDS = 64
GRAM = 3
#: Keys over which names are dealt to patterns that match every name.
SALTS = 32


def _grams(text: Column, size: Column) -> Column:
    """All pieces of a text of so many characters."""
    starts = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, size))


def _wanted(patterns: DataFrame) -> DataFrame:
    """pattern, kind, part, parts: what a name must have for each distinct pattern.

    exact: all of it; head, tail: the text before the first or after the last ``*``; gram: pieces of the
    texts between two, of as many characters as the longest of them allows; all: nothing.
    """
    head, tail = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    texts = F.filter(F.split("pattern", r"\*"), lambda t: t != "")
    size = F.least(F.lit(GRAM), F.array_max(F.transform(texts, lambda t: F.char_length(t))))
    row = lambda kind, part, parts=F.lit(None).cast("array<string>"): F.struct(F.lit(kind).alias("kind"), part.cast("string").alias("part"), parts.alias("parts"))
    made = (
        F.when(F.instr("pattern", "*") == 0, row("exact", F.col("pattern"))).when(head != "", row("head", F.left(head, F.lit(ENDS))))
        .when(tail != "", row("tail", F.right(tail, F.lit(ENDS)))).when(F.size(texts) == 0, row("all", F.lit("")))
        .otherwise(row("gram", F.lit(None), F.array_distinct(F.flatten(F.transform(texts, lambda t: _grams(t, size)))))))
    return patterns.select("pattern").where("pattern is not null").distinct().select("pattern", made.alias("w")).select("pattern", "w.*")


def _keys(names: DataFrame, sizes: DataFrame) -> DataFrame:
    """source, kind, part, salt: what each distinct name is found by, of the kinds and lengths that patterns ask for."""
    ask = lambda kind: F.transform(F.filter("sizes", lambda s: s["kind"] == kind), lambda s: s["n"])
    has = lambda n: n <= F.char_length("source")
    row = lambda kind, part: F.struct(F.lit(kind).alias("kind"), part.alias("part"))
    ends = lambda kind, cut: F.transform(F.filter(ask(kind), has), lambda n: row(kind, cut(F.col("source"), n)))
    grams = F.array_distinct(F.flatten(F.transform(ask("gram"), lambda n: _grams(F.col("source"), n))))
    whole = lambda kind, part: F.transform(ask(kind), lambda _: row(kind, part))
    every = F.concat(whole("exact", F.col("source")), whole("all", F.lit("")), ends("head", F.left), ends("tail", F.right), F.transform(grams, lambda g: row("gram", g)))
    keyed = names.select("source").where("source is not null").distinct().select("source", sizes.scalar().alias("sizes")).select("source", F.inline(every))
    return keyed.withColumn("salt", F.when(F.col("kind") == "all", F.pmod(F.xxhash64("source"), F.lit(SALTS))).otherwise(0).cast("int"))


def _asked(wanted: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What patterns look names up by, a row for each key, and the keys of names."""
    n = F.when(F.col("kind").isin("exact", "all"), 0).otherwise(F.coalesce(F.char_length("part"), F.char_length(F.col("parts")[0])))
    # One row: a kind and a length of at most ENDS each.
    keys = _keys(names, wanted.agg(F.collect_set(F.struct("kind", n.alias("n"))).alias("sizes")))
    held = keys.where("kind = 'gram'").groupBy("part").agg(F.count("*").alias("n"))
    grams = wanted.where("kind = 'gram'").select("pattern", F.explode("parts").alias("part")).join(held, "part", "left")
    rarest = grams.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "part"))["part"].alias("part"))
    salts = F.when(F.col("kind") == "all", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    asked = wanted.where("kind <> 'gram'").select("pattern", "kind", "part").unionByName(rarest.select("pattern", F.lit("gram").alias("kind"), "part"))
    return asked.withColumn("salt", F.explode(salts)), keys


def matches(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(pattern, source) of all distinct patterns and names that match; null ones match nothing.

    One equality join, verified then: patterns without ``*`` by the name, others by the literal text before
    their first ``*``, or after their last one. A pattern with a ``*`` at both ends looks up the rarest of
    its pieces of three characters in posting lists of all names; only ``*`` itself meets every name, over SALTS keys.
    """
    asked, keys = _asked(_wanted(patterns), names)
    hit = asked.join(keys, ["kind", "part", "salt"])
    return hit.where(F.col("kind").isin("exact", "all") | wildcard_match("pattern", "source")).select("pattern", "source")


def rule_patterns(rules: DataFrame) -> DataFrame:
    """One row per pattern with its place: rule_id, ordinal, pattern."""
    return rules.select("rule_id", F.posexplode("patterns").alias("ordinal", "pattern"))


def pattern_edges(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (rule_id, source) for which any pattern matches, from names alone."""
    # Rules are never broadcast: the planner takes exploded patterns for no larger than the rules' compressed files.
    patterns = rule_patterns(rules).select("rule_id", "pattern").hint("merge")
    return patterns.join(matches(patterns, sources), "pattern").select("rule_id", "source").distinct()


def filter_sources(sources: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Sources that an include pattern matches (all if there is none) and no exclude pattern."""
    any_of = lambda ps: F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: wildcard_match(p, "source"))
    kept = sources.where(any_of(include)) if include else sources
    return kept.where(~any_of(exclude)) if exclude else kept


def remote_selector(pattern: str | Column) -> Column:
    """Whether a selector names another cluster: a colon outside braces."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\{[^{}]*\}", ""), r"\{[^{}]*\}", "")
    return F.contains(plain, F.lit(":"))


def split_selectors(rules: DataFrame) -> DataFrame:
    """rule_id, local and remote: trimmed selectors without empty ones."""
    trimmed = F.filter(F.transform("patterns", lambda p: F.trim(p)), lambda p: p != "")
    return rules.select("rule_id", F.filter(trimmed, lambda p: ~remote_selector(p)).alias("local"), F.filter(trimmed, remote_selector).alias("remote"))


def detector_patterns(rules: DataFrame, nested: str) -> DataFrame:
    """Nested lists of patterns flattened: trimmed, without empty ones, the first of equal ones."""
    flat = F.filter(F.transform(F.flatten(nested), lambda p: F.trim(p)), lambda p: p != "")
    return rules.select("rule_id", F.array_distinct(flat).alias("patterns"))


def diagnostic_selectors(rules: DataFrame) -> DataFrame:
    """For rules of two or more positive selectors a row for each, with all exclusions: rule_id, selector, expression."""
    positive = F.array_distinct(F.filter("patterns", lambda p: ~p.startswith("-")))
    negative = F.filter("patterns", lambda p: p.startswith("-"))
    cut = rules.select("rule_id", positive.alias("positive"), negative.alias("negative")).where("size(positive) >= 2")
    return cut.select("rule_id", F.explode("positive").alias("selector"), "negative").select("rule_id", "selector", F.array_join(F.concat(F.array("selector"), "negative"), ",").alias("expression"))


def input_status(rules: DataFrame) -> DataFrame:
    """Rules (kind, query, patterns, data_view, enabled) classified before any selector is resolved."""
    n = F.size(F.coalesce("patterns", F.array().cast("array<string>")))
    view = F.coalesce("data_view", F.lit("")) != ""
    status = (
        F.when(F.col("enabled").isNull(), "unavailable")
        .when(~F.col("kind").isin("query", "esql"), "unsupported")
        .when((F.col("kind") == "esql") & ((n > 0) | view), "ambiguous")
        .when((n > 0) & view, "ambiguous")
        .when((F.col("kind") == "query") & (n == 0) & ~view, "unsupported")
    )
    return rules.withColumns({"input_status": status, "enabled": F.coalesce("enabled", F.lit(False))})


def declared_inputs(rules: DataFrame, query: str = "query") -> DataFrame:
    """rule_id, inputs, detail: the tables after FROM in a query's text, or why they can't be told."""
    bare = F.regexp_replace(F.coalesce(query, F.lit("")), r"\A\x{FEFF}?(?:\s+|//[^\n]*(?:\n|\z)|/\*(?s:.*?)\*/)*", "")
    command = F.regexp_extract(bare, r"(?is)\A(from\s+(?:`[^`]*`|\"[^\"]*\"|[^|`\"])*)", 1)
    bare_ends = lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")
    body = bare_ends(F.regexp_replace(F.regexp_replace(command, r"(?is)\Afrom\s+", ""), r"(?is)\s+metadata\s.*\z", ""))
    names = F.transform(F.regexp_extract_all(body, F.lit(r"((?:`[^`]*`|[^,`])+)"), F.lit(1)), bare_ends)
    inputs = F.array_distinct(F.filter(F.transform(names, lambda x: F.regexp_replace(x, r"\A`([^`]*)`\z", "$1")), lambda x: x != ""))
    outside = F.regexp_replace(body, "`[^`]*`", "q")
    odd = F.exists(names, lambda x: ~F.regexp_like(x, F.lit(r"\A`[^`]*`\z")) & F.regexp_like(x, F.lit(r"[?$\"'`\s]")))
    detail = F.when(command == "", "query does not start with FROM").when(F.regexp_like(outside, F.lit(r"[()]")), "subqueries are not supported").when(odd, "input is not a plain name").when(F.size(inputs) == 0, "no input")
    return rules.select("rule_id", F.when(detail.isNull(), inputs).otherwise(F.array().cast("array<string>")).alias("inputs"), detail.alias("detail"))


def resolve_selectors(rules: DataFrame, sources: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Authoritative resolutions: rule_id, expression, status, resolved_sources (sorted).

    The local selectors of a rule make one expression: what any positive one matches without what an
    exclusion (``-x``) matches. Remote selectors make a row of their own. A rule whose input_status is
    set keeps it. aliases: alias, source; names resolve through them.
    """
    if "input_status" not in rules.columns:
        rules = rules.withColumn("input_status", F.lit(None).cast("string"))
    names = sources.select(F.col("source").alias("name"), "source")
    if aliases is not None:
        names = names.unionByName(aliases.select(F.col("alias").alias("name"), "source")).distinct()
    split = split_selectors(rules).join(rules.select("rule_id", "input_status"), "rule_id")
    open_ = split.where("input_status is null")
    local = open_.where("size(local) > 0").select("rule_id", F.explode("local").alias("selector"), F.array_join("local", ",").alias("expression"))
    signed = local.select("rule_id", F.col("selector").startswith("-").alias("minus"), F.regexp_replace("selector", "^-", "").alias("pattern"))
    hit = matches(signed, names.select(F.col("name").alias("source"))).withColumnRenamed("source", "name").join(names, "name")
    found = signed.join(hit, "pattern").select("rule_id", "minus", "source").groupBy("rule_id", "source").agg(F.bool_or("minus").alias("minus")).where("not minus")
    resolved = found.groupBy("rule_id").agg(F.array_sort(F.collect_set("source")).alias("resolved_sources"))
    none = F.array().cast("array<string>")
    locals_ = local.select("rule_id", "expression").distinct().join(resolved, "rule_id", "left").select(
        "rule_id", "expression", F.when(F.col("resolved_sources").isNull(), "empty").otherwise("resolved").alias("status"), F.coalesce("resolved_sources", none).alias("resolved_sources"))
    remote = open_.where("size(remote) > 0").select("rule_id", F.array_join("remote", ",").alias("expression"), F.lit("remote").alias("status"), none.alias("resolved_sources"))
    nothing = open_.where("size(local) = 0 and size(remote) = 0").select("rule_id", F.lit("").alias("expression"), F.lit("unsupported").alias("status"), none.alias("resolved_sources"))
    kept = split.where("input_status is not null").select("rule_id", F.lit("").alias("expression"), F.col("input_status").alias("status"), none.alias("resolved_sources"))
    return locals_.unionByName(remote).unionByName(nothing).unionByName(kept)


def diagnostic_resolutions(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """What each positive selector of a rule resolves to alone: rule_id, selector, expression, status, resolved_sources."""
    one = diagnostic_selectors(rules).where(~remote_selector("selector"))
    key = F.concat_ws("\0", "rule_id", "selector")
    alone = resolve_selectors(one.select(key.alias("rule_id"), F.split("expression", ",").alias("patterns")), sources)
    return one.withColumn("key", key).join(alone.select(F.col("rule_id").alias("key"), "status", "resolved_sources"), "key").drop("key")


def alias_expand(targets: DataFrame, aliases: DataFrame, partitions: DataFrame) -> DataFrame:
    """rule_id, name -> rule_id, sources: aliases and partitions replaced by their stream; sorted, each once."""
    named = targets.join(aliases.select(F.col("alias").alias("name"), F.col("source").alias("by_alias")), "name", "left")
    named = named.join(partitions.select(F.col("partition").alias("name"), F.col("source").alias("by_partition")), "name", "left")
    source = F.coalesce("by_alias", "by_partition", "name")
    return named.groupBy("rule_id").agg(F.array_sort(F.collect_set(source)).alias("sources"))


def resolved_edges(resolutions: DataFrame, rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (rule_id, source) from authoritative resolved rows whose rule and source are known."""
    rows = resolutions.where("status = 'resolved'").select("rule_id", F.explode("resolved_sources").alias("source")).distinct()
    return rows.join(rules.select("rule_id"), "rule_id", "left_semi").join(sources.select("source"), "source", "left_semi")


def missing_targets(resolutions: DataFrame, sources: DataFrame) -> DataFrame:
    """rule_id, targets: resolved names that the inventory lacks."""
    rows = resolutions.where("status = 'resolved'").select("rule_id", F.explode("resolved_sources").alias("source")).distinct()
    return rows.join(sources.select("source"), "source", "left_anti").groupBy("rule_id").agg(F.array_sort(F.collect_set("source")).alias("targets"))


def blast_radius(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """source, consumers, disabled, rule_ids (enabled ones)."""
    on = F.col("enabled")
    return edges.join(rules.select("rule_id", "enabled").hint("merge"), "rule_id").groupBy("source").agg(
        F.count_if(on).alias("consumers"), F.count_if(~on).alias("disabled"), F.array_sort(F.collect_set(F.when(on, F.col("rule_id")))).alias("rule_ids"))


def windows_on_event_time(override: str | Column = "timestamp_override") -> Column:
    return F.coalesce(override, F.lit("")).isin("", "@timestamp")


def freshness_clock(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """source, basis: the clock of a source's enabled rules."""
    used = edges.join(rules.where("enabled").select("rule_id", windows_on_event_time().alias("by_event")), "rule_id")
    flags = used.groupBy("source").agg(F.bool_or("by_event").alias("event"), F.bool_or(~F.col("by_event")).alias("ingest"))
    return flags.select("source", F.when(F.col("event") & F.col("ingest"), "mixed").when(F.col("ingest"), "ingestion_time").otherwise("event_time").alias("basis"))


def report_ids(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The id a report shows: the stored object's if there is one; the logical id beside it where it differs."""
    stored = F.nullif(F.coalesce("backend_object_id", F.lit("")), F.lit(""))
    return rows.join(rules.select("rule_id", "backend_object_id"), "rule_id", "left").select(
        F.coalesce(stored, F.col("rule_id")).alias("id"), F.when(stored.isNotNull() & (stored != F.col("rule_id")), F.col("rule_id")).alias("logical_id"), *[c for c in rows.columns if c != "rule_id"])


def validate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that are empty after trimming, or occur more than once: id, n, problem."""
    by_id = rows.groupBy(F.trim(F.coalesce(key, F.lit(""))).alias("id")).agg(F.count("*").alias("n"))
    return by_id.select("id", "n", F.when(F.col("id") == "", "empty").when(F.col("n") > 1, "duplicate").alias("problem")).where("problem is not null")


def rule_resolution(outcomes: DataFrame) -> DataFrame:
    """rule_id, status, detail, sources from outcomes (rule_id, ordinal, required, monitorable, status, detail, sources).

    The first unavailable, unsupported, ambiguous or remote input decides; then the first required one
    that isn't resolved; then an incompatible optional one; else all resolved sources together.
    """
    uncertain = F.col("status").isin("unavailable", "unsupported", "ambiguous", "remote")
    rank = (
        F.when(uncertain, 1).when(F.col("required") & (F.col("status") != "resolved"), 2).when(~F.col("required") & (F.col("status") == "incompatible"), 3)
        .when((F.col("status") == "resolved") & F.col("monitorable"), 4).when(F.col("status") == "resolved", 5).otherwise(6))
    first = F.min(F.struct(rank.alias("rank"), "ordinal", "status", "detail")).alias("f")
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when((F.col("status") == "resolved") & F.col("monitorable"), F.col("sources"))))))
    by_rule = outcomes.groupBy("rule_id").agg(first, sources.alias("sources"))
    status = F.when(F.col("f.rank") == 5, "unsupported").otherwise(F.col("f.status"))
    detail = F.when(F.col("f.rank") == 5, "only inputs without telemetry").otherwise(F.col("f.detail"))
    return by_rule.select("rule_id", status.alias("status"), detail.alias("detail"), F.when(status == "resolved", F.col("sources")).otherwise(F.array().cast("array<string>")).alias("sources"))


def dependency_outcomes(rule_deps: DataFrame, catalog: DataFrame, metadata_complete: bool = True) -> DataFrame:
    """Outcomes of a rule's named inputs against a table catalog (table, plan, provisioned).

    An input that a rule names both as required and optional is required.
    """
    named = rule_deps.groupBy("rule_id", "input").agg(F.bool_or("required").alias("required"), F.min("ordinal").alias("ordinal"))
    joined = named.join(catalog.select(F.col("table").alias("input"), "plan", "provisioned"), "input", "left")
    status = (
        F.when(F.col("plan").isNull(), "empty" if metadata_complete else "unavailable").when(~F.col("provisioned"), "unavailable")
        .when(F.col("plan").isin("Basic", "Auxiliary"), "incompatible").otherwise("resolved"))
    detail = F.when(status == "resolved", "").otherwise(F.concat(F.col("input"), F.lit(": "), status))
    return joined.select("rule_id", "input", "ordinal", "required", F.lit(True).alias("monitorable"), status.alias("status"), detail.alias("detail"), F.when(status == "resolved", F.array("input")).otherwise(F.array().cast("array<string>")).alias("sources"))


def watchlist_dependencies(rule_deps: DataFrame, lookups: DataFrame) -> DataFrame:
    """Outcomes of lookup inputs: evidence without telemetry. lookups: alias."""
    known = lookups.select(F.lower("alias").alias("key")).distinct().withColumn("known", F.lit(True))
    joined = rule_deps.withColumn("key", F.lower("input")).join(known, "key", "left")
    status = F.when(F.col("known"), "resolved").otherwise("empty")
    return joined.select("rule_id", "input", "ordinal", "required", F.lit(False).alias("monitorable"), status.alias("status"), F.lit("").alias("detail"), F.array().cast("array<string>").alias("sources"))


def cross_workspace_limits(rule_deps: DataFrame, workspaces: DataFrame, home_region: str, most: int = 20) -> DataFrame:
    """rule_id, status of rules that read other workspaces. workspaces: workspace, region; rule_deps: rule_id, workspace.

    More than ``most`` workspaces or regions with the home one are incompatible; a workspace without a
    region is unavailable, one that isn't listed remote.
    """
    joined = rule_deps.select("rule_id", "workspace").distinct().join(workspaces.withColumn("listed", F.lit(True)), "workspace", "left")
    by_rule = joined.groupBy("rule_id").agg(
        F.count_if("listed").alias("n"), F.size(F.array_union(F.collect_set("region"), F.array(F.lit(home_region)))).alias("regions"),
        F.bool_or(F.col("listed").isNull()).alias("unlisted"), F.bool_or(F.col("listed") & F.col("region").isNull()).alias("no_region"))
    status = F.when(F.col("unlisted"), "remote").when(F.col("n") > most - 1, "incompatible").when(F.col("no_region"), "unavailable").when(F.col("regions") >= most, "incompatible").otherwise("resolved")
    return by_rule.select("rule_id", F.col("n").alias("workspaces"), "regions", status.alias("status"))


def first_match(candidates: DataFrame, key: list[str], ordinal: str, value: str) -> DataFrame:
    """The value of the lowest ordinal for each key."""
    return candidates.groupBy(*key).agg(F.min_by(value, ordinal).alias(value))


def latest_run(runs: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The whole row of the latest time for each key; ties go to the largest row."""
    rest = [c for c in runs.columns if c not in (*key, ts)]
    return runs.groupBy(*key).agg(F.max(F.struct(ts, *rest)).alias("r")).select(*key, "r.*")


def dependency_evidence(supplied: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """Supplied and resolved dependencies with their rule's name and severity; of equal keys the supplied one."""
    key = ["rule_id", "id", "name", "kind", "scope", "monitorable", "required"]
    both = supplied.withColumn("ordinal", F.lit(0)).unionByName(found.withColumn("ordinal", F.lit(1)))
    one = both.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("ordinal", "status"))).where("n = 1").drop("n", "ordinal")
    return one.join(rules.select("rule_id", F.col("name").alias("rule_name"), "severity"), "rule_id", "left")
