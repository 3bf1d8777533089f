"""What a reviewer's desk does with findings: names, targets, lists, limits, sets, and the merged report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Characters that only traditional script uses, and how many different ones tell it.
TRADITIONAL = "這說對於個們時來後會學國發經產業點麼樣實現過導應該當開關頭萬與觀係響價證論認識義議標準處據隨營歸雙擊參態豐執顯錯測驗總結構檢"
TRADITIONAL_LEAST = 3
# A rule's handling as the desk names it, and the order in which a rule of several counts.
HANDLING = {"code": "safe", "llm": "rewrite", "report": "review"}
PRECEDENCE = ["report", "code", "llm"]
SEVERITY = ["high", "medium", "low"]


def is_traditional(text: Column) -> Column:
    """Whether a text holds three different characters of traditional script."""
    marks = F.array(*[F.lit(c) for c in dict.fromkeys(TRADITIONAL)])
    return F.size(F.array_intersect(F.split(text, ""), marks)) >= TRADITIONAL_LEAST


def notices(report: dict[str, Column], traditional: Column) -> Column:
    """What a reader is told about a text's clean-up: array<struct<level, text>>, without what did not happen."""
    odd = report["variation"] + report["odd_spaces"]
    say = lambda holds, level, *words: F.when(holds, F.struct(F.lit(level).alias("level"), F.concat_ws(" ", *words).alias("text")))
    return F.array_compact(
        F.array(
            say(report["invisible"] > 0, "warn", F.lit("invisible characters removed:"), report["invisible"]),
            say(report["control"] > 0, "warn", F.lit("control characters removed:"), report["control"]),
            say(odd > 0, "info", F.lit("odd blanks and variants made plain:"), odd),
            say(traditional, "warn", F.lit("traditional script: the rules cover simplified script only")),
        )
    )


def distinct_notices(told: DataFrame) -> DataFrame:
    """Each notice of a document once."""
    return told.dropDuplicates(["doc_id", "level", "text"])


# --- names -------------------------------------------------------------------------------------------------------------


def rule_handling(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with the handling of their (lang, rule): of several the first of PRECEDENCE, none gives an empty one."""
    order = F.array_position(F.array(*[F.lit(h) for h in PRECEDENCE]), F.col("handling"))
    own = rules.where(F.col("handling").isin(PRECEDENCE)).groupBy("lang", "rule").agg(F.min_by("handling", order).alias("handling"))
    return found.drop("handling").join(own, ["lang", "rule"], "left").fillna("", ["handling"])


def desk_handling(handling: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in HANDLING.items() for x in pair]), handling)


def desk_category(rule: Column) -> Column:
    return F.when(rule.startswith("V-"), "EN-V").when(rule.startswith("F"), "EN-F").otherwise("EN-S")


def desk_findings(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings of English rules as the desk lists them: ``EN-`` names, category, handling, words as the source has them, paragraphs from 1."""
    own = found.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id")
    matched = F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start"))
    return own.select(
        "doc_id", F.concat(F.lit("EN-"), "rule").alias("rule"), desk_category(F.col("rule")).alias("category"), desk_handling(F.col("handling")).alias("handling"),
        "start", "end", matched.alias("matched"), (F.col("para") + 1).alias("para"),
    )


def span_language(spans: DataFrame, paras: DataFrame) -> DataFrame:
    """Each span's language; one without Han or Latin has its paragraph's."""
    p = paras.select("doc_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"), X.language(F.col("text")).alias("p_lang"))
    inside = (F.col("p_start") <= F.col("start")) & (F.col("end") <= F.col("p_end"))
    both = spans.alias("s").join(p.withColumnRenamed("doc_id", "p_doc"), (F.col("s.doc_id") == F.col("p_doc")) & inside, "left")
    letters = F.col("matched").rlike(f"[A-Za-z]|{X.HAN}")
    return both.withColumn("lang", F.when(letters, X.language(F.col("matched"))).otherwise(F.coalesce("p_lang", F.lit("zh")))).drop("p_doc", "p_start", "p_end", "p_lang")


# --- targets and filters -------------------------------------------------------------------------------------------------


def resolve_targets(targets: DataFrame, found: DataFrame, docs: DataFrame, most: int = 500) -> DataFrame:
    """Each target ``doc_id, rule, start, end, matched`` with its state: ``range``, ``long``, ``stale`` (the text differs there), ``unknown`` or ``ok``."""
    held = targets.join(docs.select("doc_id", "text"), "doc_id", "left")
    known = found.select("doc_id", "rule", "start", "end", "matched").distinct().withColumn("known", F.lit(True))
    held = held.join(known, ["doc_id", "rule", "start", "end", "matched"], "left")
    size = F.col("end") - F.col("start")
    bad = F.col("text").isNull() | (F.col("start") < 0) | (size <= 0) | (F.col("end") > F.length("text"))
    stale = F.substring("text", F.col("start") + 1, size) != F.col("matched")
    state = F.when(bad, "range").when(size > most, "long").when(stale, "stale").when(F.col("known").isNull(), "unknown").otherwise("ok")
    return held.withColumn("state", state).drop("text", "known")


def table_filter(df: DataFrame, columns: list[str], query: str, status: str | None = None) -> DataFrame:
    """Rows of a status (null: any) whose columns, one behind the other, hold ``query`` in any case."""
    hit = F.lower(F.concat_ws(" ", *columns)).contains(query.lower())
    return df.where(hit if status is None else hit & (F.col("status") == status))


def issues(found: DataFrame, handling: str) -> DataFrame:
    """Findings of one handling by category, worst and first ones first: ``doc_id, category, place, rule, start``."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    w = Window.partitionBy("doc_id", "category").orderBy(rank, "start", "end", "rule")
    return found.where(F.col("handling") == handling).withColumn("place", F.row_number().over(w)).select("doc_id", "category", "place", "rule", "start")


def safe_cleanups(found: DataFrame) -> DataFrame:
    """Findings of each document that a clean-up may change without a reader: safe and not English."""
    safe = (F.col("handling") == "safe") & (F.col("lang") != "en") & ~F.col("rule").startswith("EN-")
    return found.groupBy("doc_id").agg(F.count_if(safe).alias("n_safe"))


def rewrite_targets(found: DataFrame, semantic: list[str], leader: str = "S01", follower: str = "S11") -> DataFrame:
    """Findings of semantic rules; where a paragraph has an English ``leader``, only those of the ``follower``."""
    led = F.max(((F.col("lang") == "en") & (F.col("rule") == leader)).cast("int")).over(Window.partitionBy("doc_id", "para"))
    return found.withColumn("led", led).where(F.col("rule").isin(semantic) & ((F.col("led") == 0) | (F.col("rule") == follower))).drop("led")


def may_start(report: Column, allowed: Column, units: Column, most: Column, balance: Column, seen: Column, now: Column) -> Column:
    """Whether an edit may start: there is a report, of the text as it is now, and strength, size and balance allow it."""
    return F.coalesce(report & allowed & (units > 0) & (units <= most) & (balance >= units) & seen.eqNullSafe(now), F.lit(False))


def useful_ablations(base: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants whose rule hits the base text and whose edit changes it."""
    return variants.join(base.where("n > 0").select("base", "rule"), ["base", "rule"], "left_semi").where("NOT (new_text <=> old_text)")


# --- lines ---------------------------------------------------------------------------------------------------------------


def eligible_lines(lines: DataFrame) -> DataFrame:
    """Lines (``start, end, targets, reviews`` as arrays of spans) that overlap a target and no span under review."""
    touches = lambda spans: F.exists(spans, lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    return lines.withColumn("eligible", touches("targets") & ~touches("reviews"))


def carry_eligibility(lines: DataFrame) -> DataFrame:
    """Blank lines between two lines of one eligibility take it: ``doc_id, line, blank, eligible`` with ``carried``."""
    own = F.when(~F.col("blank"), F.col("eligible"))
    w = Window.partitionBy("doc_id").orderBy("line")
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return lines.withColumn("carried", F.when(~F.col("blank"), F.col("eligible")).otherwise(F.coalesce(before & after, F.lit(False))))


def editable_parts(lines: DataFrame) -> DataFrame:
    """Neighbouring lines of one eligibility (``doc_id, line, text, carried``) as parts: ``doc_id, part, carried, first, last, text``."""
    w = Window.partitionBy("doc_id").orderBy("line")
    new = F.coalesce((F.col("carried") != F.lag("carried").over(w)).cast("int"), F.lit(0))
    numbered = lines.withColumn("new", new).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return numbered.groupBy("doc_id", "part", "carried").agg(F.min("line").alias("first"), F.max("line").alias("last"), joined.alias("text"))


def edit_window(text: Column, start: Column, end: Column) -> Column:
    """The lines that a span stands in, from the line feed before it to the one behind: struct<start, text>."""
    lead = F.substring_index(F.substring(text, 1, start), "\n", -1)
    tail = F.substring_index(F.substr(text, end + 1), "\n", 1)
    return F.struct((start - F.length(lead)).alias("start"), F.concat(lead, F.substring(text, start + 1, end - start), tail).alias("text"))


def preflight(targets: DataFrame) -> DataFrame:
    """How many paragraphs, and findings, a rewrite of each document would touch."""
    return targets.groupBy("doc_id").agg(F.count_distinct("para").alias("paragraphs"), F.count("*").alias("findings"))


def inside_edits(found: DataFrame, edits: DataFrame) -> DataFrame:
    """Findings with whether an edited span of their document (``doc_id, spans``) touches them."""
    both = found.join(edits, "doc_id", "left")
    hit = F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    return both.withColumn("edited", F.coalesce(hit, F.lit(False))).drop("spans")


def changed_passages(pairs: DataFrame, most: int = 200) -> DataFrame:
    """Of paragraph pairs ``doc_id, para, before, after``: the changed ones, or one row without a place if they are more than ``most``."""
    changed = pairs.where(~F.col("before").eqNullSafe(F.col("after")))
    n = changed.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    few = n.where(F.col("n") <= most).select("doc_id", "para", F.lit(1).cast("long").alias("n"))
    return few.unionByName(n.where(F.col("n") > most).select("doc_id", F.lit(None).cast("int").alias("para"), "n").distinct())


# --- limits ----------------------------------------------------------------------------------------------------------------


def exempt_by_budget(counts: DataFrame, budget: int) -> DataFrame:
    """Rules of each document that the noise budget exempts: by rising number of edits, as long as their sum stays within it."""
    w = Window.partitionBy("doc_id").orderBy("n", "rule").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("spent", F.sum("n").over(w)).withColumn("exempt", F.col("spent") <= budget)


def heaviest_paragraphs(scored: DataFrame, k: int) -> DataFrame:
    """The k paragraphs of each document with the largest weighted sum, in the text's order."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("weighted"), "para")
    kept = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("para"))).select("doc_id", "place", "para", "weighted")


def first_items(items: Column, k: int) -> Column:
    """The first k items, and how many there are behind them."""
    return F.struct(F.slice(items, 1, k).alias("items"), F.greatest(F.lit(0), F.size(items) - k).alias("more"))


# --- sets ------------------------------------------------------------------------------------------------------------------


def lost_terms(source: Column, output: Column, lexicon: list[str]) -> Column:
    """Terms that the output lacks, but for those that are, or stand inside, words of the lexicon."""
    own = F.array(*[F.lit(t) for t in lexicon])
    return F.filter(F.array_except(source, output), lambda t: ~F.exists(own, lambda w: F.contains(F.lower(w), F.lower(t))))


def new_rules(before: Column, after: Column, report_only: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array_except(after, before), F.array(*[F.lit(r) for r in report_only])))


def same_bag(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def in_first_order(first: Column, second: Column) -> Column:
    """The distinct items of both, those of the first before new ones of the second."""
    return F.array_union(F.array_distinct(first), F.array_distinct(second))


def missing_tables(have: Column, required: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(t) for t in required]), have))


def shared_texts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Texts of ``left`` that ``right`` has as well, by digest; empty if two sets are disjoint."""
    key = F.md5(F.col("text").cast("binary")).alias("key")
    return left.select("*", key).join(right.select(key).distinct(), "key", "left_semi").drop("key")


def catalogue(products: DataFrame, prices: DataFrame, free: str) -> DataFrame:
    """Each product and the free one with a map of its prices by currency, empty for the free one."""
    priced = prices.groupBy("product").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency", "amount")))).alias("prices"))
    none = F.create_map().cast("map<string,bigint>")
    own = products.join(priced, "product", "left").select(F.col("product").cast("string").alias("product"), F.coalesce("prices", none).alias("prices"))
    return products.sparkSession.range(1).select(F.lit(free).alias("product"), none.alias("prices")).unionByName(own)


# --- reports ---------------------------------------------------------------------------------------------------------------


def merge_findings(zh: DataFrame, en: DataFrame) -> DataFrame:
    """Findings of both engines, each rule and span of a document once, numbered by place."""
    both = zh.unionByName(en).dropDuplicates(["doc_id", "rule", "start", "end"])
    return both.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "rule")))


def merge_guards(results: DataFrame) -> DataFrame:
    """Guard results ``doc_id, lang, added, removed, blocked, changes`` of several languages as one for each document."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return results.groupBy("doc_id").agg(every("added"), every("removed"), F.bool_or("blocked").alias("blocked"), F.sum("changes").alias("changes"))


def checks_of(text: Column) -> Column:
    """How many checks a text's report has: 31 for Chinese, 13 for English, both for mixed texts."""
    han, phrase = text.rlike(X.HAN), text.rlike(r"[A-Za-z]+(?:[ \t]+[A-Za-z]+){2,}")
    return F.when(han & phrase, 44).when(X.language(text) == "zh", 31).otherwise(13)


def edit_tally(log: DataFrame) -> DataFrame:
    """Edits ``rule, name, lang, n, reverted`` summed by rule, most first, with the terms that undone ones would have lost."""
    terms = F.array_sort(F.array_distinct(F.flatten(F.collect_list("reverted")))).alias("reverted")
    return log.groupBy("rule", "name", "lang").agg(F.sum("n").alias("n"), terms).orderBy(F.desc("n"), "rule", "lang")


def rewrite_totals(paras: DataFrame) -> DataFrame:
    """Targeted, accepted, unverified and untouched paragraphs of each document, and its safe changes."""
    return paras.groupBy("doc_id").agg(
        F.count_if("targeted").alias("n_targeted"), F.count_if(F.col("targeted") & F.col("accepted")).alias("n_accepted"),
        F.count_if(F.col("accepted") & ~F.col("verified")).alias("n_unverified"), F.count_if(~F.col("targeted")).alias("untouched"), F.sum("safe").alias("safe_changes"),
    )


def report_text(summary: DataFrame) -> DataFrame:
    """A document summary as a few lines for a reader."""
    line = lambda name, *cols: F.concat_ws(" ", F.lit(name), *cols)
    found = line("findings:", F.concat("n_high", F.lit(" high,")), F.concat("n_medium", F.lit(" medium,")), F.concat("n_low", F.lit(" low")))
    where = line("paragraphs:", F.concat(F.col("n_affected"), F.lit(" of "), F.col("n_paragraphs"), F.lit(" affected")))
    return summary.select("doc_id", F.concat_ws("\n", line("status:", F.col("status")), line("characters:", F.col("n_chars")), where, found).alias("report"))
