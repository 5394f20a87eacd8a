"""The checks of a record: its text against its declared script and language, its labels against the taxonomy and the
family it was written for, its facts against what the text states; then disputes and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators.dedup import exact_duplicates, near_rejects
from granary.operators.workspace import TEXTS, materialize
from granary.sources.configs import Taxonomy

SHORTEST, LONGEST = 8, 700
REALSTYLE = "realstyle"
UNRESOLVABLE = ("vague", "multi_issue:no_priority")
#: A category is warned about below this share of its domain's accepted records, once there are so many.
LOW_SHARE, ENOUGH = 0.05, 100


def by_domain(tax: Taxonomy, domain: Column, make) -> Column:
    """``make(name)`` of the record's domain; null for a domain that the taxonomy lacks."""
    return reduce(lambda out, d: F.when(domain == d, make(d)).otherwise(out), reversed(list(tax.domains)), F.lit(None))


def leaked(message: Column, categories: dict[str, str]) -> Column:
    """Whether a text gives a category away: by its id, by a long id written as words, or by its description."""
    low, plain = F.lower(message), X.normalize(message)
    tests = [F.contains(low, F.lit(c)) for c in categories if "_" in c]
    tests += [F.contains(plain, F.lit(c.replace("_", " "))) for c in categories if c.count("_") >= 2]
    tests += [F.contains(plain, F.lit(X.normal(d))) for d in categories.values()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def nepali_count(words: Column | None = None) -> Column:
    """The Nepali markers of a message in its declared script."""
    text = F.col("message")
    return F.when(F.col("script") == "deva", X.nepali_markers(text, "deva", words)).otherwise(X.nepali_markers(text, "roman", words))


def rules(tax: Taxonomy, words: Column | None = None, nepali: Column | None = None) -> list[tuple[str, Column]]:
    """Names and conditions of broken rules, in the order in which they count. The first two end the check. ``words`` and
    ``nepali`` are columns of the message's words and ``nepali_count``, where there are any."""
    c = F.col
    text, script, family, label = c("message"), c("script"), c("difficulty_family"), c("labels.issue")
    found = X.detect_script(text)
    forgiven = F.array_contains("style_tags", REALSTYLE) & (script == "deva") & (found == "mixed")
    nepali = nepali_count(words) if nepali is None else nepali
    hindi = F.when(script == "deva", X.hindi_markers(text, "deva", words)).otherwise(X.hindi_markers(text, "roman", words))
    known = by_domain(tax, c("domain"), lambda d: F.array(*map(F.lit, tax.categories(d))))
    targets = F.map_keys(F.coalesce("labels.issue_target", F.create_map().cast("map<string,double>")))
    strange = F.size(F.array_except(F.array_remove("issues_all", ""), known)) > 0
    open_ended = family.isin(*UNRESOLVABLE)
    asks = c("labels.clarification_needed")
    priority = (family == "multi_issue:stated_priority") & (~c("stated_priority").eqNullSafe(label) | (F.size("issues_all") < 2))
    amounts = X.amounts_in(text)
    stated = lambda k: F.array_contains(amounts, F.round(F.element_at("scenario_facts", k).try_cast("double"), 2))
    unsaid = F.exists(F.filter("visible_facts", lambda k: k.endswith("_npr")), lambda k: F.coalesce(~stated(k), F.lit(False)))
    negative = F.array_contains("style_tags", "negation") | family.startswith("negation")
    return [
        ("taxonomy_version", c("taxonomy_version") != tax.version),
        ("unknown_domain", ~c("domain").isin(*tax.domains)),
        ("too_short", F.length(text) < SHORTEST),
        ("too_long", F.length(text) > LONGEST),
        ("script_mismatch", ~found.eqNullSafe(script) & ~F.coalesce(forgiven, F.lit(False))),
        ("not_nepali", nepali == 0),
        ("hindi_not_nepali", (nepali > 0) & (hindi > nepali)),
        ("unknown_label", (label.isNotNull() & ~F.array_contains(known, label)) | (F.size(F.array_except(targets, known)) > 0) | (strange & ~label.eqNullSafe(F.lit(tax.fallback)))),
        ("label_family_mismatch", (open_ended != asks) | (open_ended == label.isNotNull()) | priority),
        ("missing_evidence", unsaid),
        ("missing_negation", negative & ~X.has_negation(text, words)),
        ("label_leakage", by_domain(tax, c("domain"), lambda d: leaked(text, tax.criteria(d)))),
    ]


def check(records: DataFrame, tax: Taxonomy) -> DataFrame:
    """``records`` with ``findings``: the names of broken rules in order. A rule that is null counts as kept; a wrong version
    or an unknown domain is the only finding of its record."""
    named = [(name, F.coalesce(broken, F.lit(False))) for name, broken in rules(tax, F.col("_words"), F.col("_nepali"))]
    (version, old), (domain, strange), *rest = named
    others = F.array_compact(F.array(*(F.when(broken, name) for name, broken in rest)))
    worded = records.withColumn("_words", X.words(F.col("message")))  # found once, used by three rules
    worded = worded.withColumn("_nepali", nepali_count(F.col("_words")))
    return worded.withColumn("findings", F.when(old, F.array(F.lit(version))).when(strange, F.array(F.lit(domain))).otherwise(others)).drop("_words", "_nepali")


def settle(checked: DataFrame) -> DataFrame:
    """``status`` and ``reason``: findings reject; a verifier that disagrees leaves the record to the adjudicator, and queues
    it where there is none. ``verifier_agrees`` and ``adjudicator_agrees`` are null where nobody was asked."""
    disputed = F.col("verifier_agrees").eqNullSafe(F.lit(False))
    ruled, upheld = F.col("adjudicator_agrees").isNotNull(), F.col("adjudicator_agrees")
    broken = F.size("findings") > 0
    status = F.when(broken | (disputed & ruled & ~upheld), "rejected").when(disputed & ~ruled, "queued").otherwise("accepted")
    reason = F.when(broken, F.get("findings", F.lit(0))).when(disputed & ruled & ~upheld, "label_disputed")
    return checked.withColumn("status", status).withColumn("reason", reason)


def validate(records: DataFrame, tax: Taxonomy, order: str, threshold: float = 0.85) -> DataFrame:
    """``records`` with ``findings``, ``status``, ``reason`` and ``duplicate_of``.

    Duplicates are sought among records that are not rejected, queued ones too: first equal normalised texts of another
    group, then, among what is left, near ones. The earlier record by ``order`` stays; ``duplicate_of`` is its order.
    """
    settled = materialize(settle(check(records, tax)), "settled", TEXTS)
    live = settled.where("status <> 'rejected'").select(order, "scenario_group_id", F.col("message").alias("text"))
    equal = materialize(exact_duplicates(live, order, "scenario_group_id"), "equal")
    near = near_rejects(live.join(equal, order, "left_anti"), order, "scenario_group_id", threshold=threshold)
    twins = equal.select(order, F.col("duplicate_of"), F.lit("exact_duplicate").alias("_why"))
    twins = twins.union(near.select(order, "near_duplicate_of", F.lit("near_duplicate")))
    joined = settled.join(twins, order, "left")
    return joined.withColumn("status", F.when(F.col("_why").isNotNull(), "rejected").otherwise(F.col("status"))).withColumn("reason", F.coalesce("_why", "reason")).drop("_why")


def report(validated: DataFrame) -> DataFrame:
    """``(section, domain, key, n)``: records by status, rejections by reason, accepted records by category, script and
    family, in one pass."""
    accepted = F.col("status") == "accepted"
    entry = lambda section, domain, key, when: F.when(when, F.struct(F.lit(section).alias("section"), domain.alias("domain"), key.alias("key")))
    none = F.lit(None).cast("string")
    entries = F.array_compact(
        F.array(
            entry("status", none, F.col("status"), F.lit(True)),
            entry("reason", none, F.col("reason"), F.col("status") == "rejected"),
            entry("issue", F.col("domain"), F.coalesce("labels.issue", F.lit("(clarify)")), accepted),
            entry("script", none, F.col("script"), accepted),
            entry("family", none, F.split_part("difficulty_family", F.lit(":"), F.lit(1)), accepted),
        )
    )
    return validated.select(F.explode(entries).alias("e")).groupBy("e.section", "e.domain", "e.key").agg(F.count("*").alias("n"))


def warnings(validated: DataFrame, tax: Taxonomy, enough: int = ENOUGH) -> DataFrame:
    """``(domain, category, n, total)`` of categories with too few accepted records, those without any too."""
    spark = validated.sparkSession
    accepted = validated.where("status = 'accepted'")
    counts = accepted.groupBy("domain", F.col("labels.issue").alias("category")).agg(F.count("*").alias("n"))
    totals = accepted.groupBy("domain").agg(F.count("*").alias("total"))
    every = F.broadcast(tax.table(spark).select("domain", "category"))
    found = totals.join(every, "domain").join(counts, ["domain", "category"], "left").select("domain", "category", F.coalesce("n", F.lit(0)).alias("n"), "total")
    return found.where((F.col("total") >= enough) & (F.col("n") < LOW_SHARE * F.col("total")))


def sound() -> Column:
    """Whether a record is one at all: exactly the external ones lack a script, exactly one kind of label is given, and a
    soft label is a distribution."""
    external = F.col("source.generator") == "external"
    target = F.map_values("labels.issue_target")
    total = F.aggregate(target, F.lit(0.0), lambda a, x: a + x)
    soft = F.col("labels.issue_target").isNotNull()
    proper = F.coalesce((F.abs(total - 1) <= 1e-6) & (F.array_min(target) >= 0), ~soft)
    return (external == F.col("script").isNull()) & (F.length("message") > 0) & (F.col("labels.issue").isNotNull() != soft) & proper


def origin(generator: Column = None, derived: Column = None, tags: Column = None) -> Column:
    """Where a record comes from: outside, a derivation, a real style, or plain synthesis."""
    generator = F.col("source.generator") if generator is None else generator
    derived = F.col("derivation").isNotNull() if derived is None else derived
    tags = F.col("style_tags") if tags is None else tags
    return F.when(generator == "external", "external").when(derived, "translated").when(F.array_contains(tags, REALSTYLE), "realstyle").otherwise("synthetic")
