"""Records put together from scenarios and what models returned, prompts and their costs."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.hashing import uniform
from granary.sources.configs import Generation, Taxonomy

#: Counters of a request's tokens, in the order of a price's entries.
COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def first_rows(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, found by a combined minimum."""
    least = df.groupBy(*key).agg(F.min_by(F.struct(*(F.col(c) for c in df.columns)), order).alias("_r"))
    return least.select("_r.*")


def build_records(scenarios: DataFrame, renderings: DataFrame, order: str, seed: int, script: Column | None = None) -> DataFrame:
    """One record a scenario that was rendered: its first rendering by ``order`` wins, renderings of unknown scenarios are
    dropped. ``script`` (deva by default) also names the record; a style variant is what has a script given."""
    first = first_rows(renderings, ["scenario_id"], order)
    met = scenarios.join(first.select("scenario_id", "message", "provider", "model", "prompt_version"), "scenario_id")
    mock = F.col("provider") == "dry_run"
    written = F.lit("deva") if script is None else script
    none = F.array().cast("array<string>")
    tag = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(none)
    tags = F.concat(F.array("style.length", "style.tone", "style.formality"), F.array(F.lit("realstyle")) if script is not None else none, tag(F.col("family") == "negation", "negation"), tag(mock, "mock") if script is None else none)
    suffix = F.concat(F.lit("-" if script is None else "-rs-"), written)
    return met.select(
        F.concat("scenario_id", suffix).alias("record_id"), "scenario_id", "scenario_group_id", "domain", "taxonomy_version",
        F.col("facts").alias("scenario_facts"), "visible_facts", "withheld_facts", F.trim("message").alias("message"), written.alias("script"),
        tags.alias("style_tags"), F.col("family").alias("difficulty_family"),
        F.struct("issue", "issue_target", "clarification_needed").alias("labels"), "issues_all", "stated_priority",
        F.struct(F.when(mock, "dry-run").otherwise("llm").alias("generator"), "provider", "model", "prompt_version", F.lit(seed).cast("long").alias("seed")).alias("source"),
    )


def merge_verdicts(records: DataFrame, verdicts: DataFrame, order: str) -> DataFrame:
    """``records`` with ``agrees`` and ``judge`` of the last verdict by ``order``: whether label and clarification are the
    record's and the language is right. Without a verdict, and for mock ones, ``agrees`` is null."""
    last = verdicts.groupBy("record_id").agg(F.max_by(F.struct("issue", "clarification_needed", "language_ok", "model", "mock"), order).alias("_v"))
    met = records.join(last, "record_id", "left")
    same = F.col("_v.issue").eqNullSafe(F.col("labels.issue")) & F.col("_v.clarification_needed").eqNullSafe(F.col("labels.clarification_needed")) & F.col("_v.language_ok")
    counted = F.col("_v").isNotNull() & ~F.coalesce("_v.mock", F.lit(False))
    return met.withColumn("agrees", F.when(counted, same)).withColumn("judge", F.col("_v.model")).drop("_v")


def verdict_counts(merged: DataFrame) -> DataFrame:
    """One row: verified, agree, disagree, mock."""
    has = F.col("agrees").isNotNull()
    return merged.agg(F.count_if(has).alias("verified"), F.count_if("agrees").alias("agree"), F.count_if(~F.col("agrees")).alias("disagree"), F.count_if(~has & F.col("judge").isNotNull()).alias("mock"))


def accepted_scenarios(scenarios: DataFrame, records: DataFrame, origin: Column) -> DataFrame:
    """Scenarios that have an accepted synthetic record."""
    kept = records.where((F.col("status") == "accepted") & (origin == "synthetic")).select("scenario_id")
    return scenarios.join(kept, "scenario_id", "left_semi")


def returned(items: DataFrame, requested: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that were asked for and are not there yet."""
    return items.join(requested.select(key), key, "left_semi").join(done.select(key), key, "left_anti")


# --- usage and cost


def cost(usage: Mapping[str, Column], prices: Column, batch: Column) -> Column:
    """Dollars of a request's tokens; ``prices`` is an array of dollars per million in the order of COUNTERS. Batches cost a
    half; an unknown price gives null."""
    total = sum((F.coalesce(usage[c], F.lit(0)) * F.get(prices, F.lit(i)) for i, c in enumerate(COUNTERS)), F.lit(0.0))
    return F.round(total / 1e6 * F.when(batch, 0.5).otherwise(1.0), 6)


def usage_totals(log: DataFrame, by: list[str]) -> DataFrame:
    """Requests, each counter and dollars by group; dollars are null where no request has any."""
    return log.groupBy(*by).agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in COUNTERS), F.round(F.sum("usd"), 4).alias("usd"))


def added(one: Mapping[str, int], other: Mapping[str, int]) -> dict[str, int]:
    """The usage of two requests together."""
    return {c: one.get(c, 0) + other.get(c, 0) for c in COUNTERS}


def estimate(plan: Generation, domains: int) -> dict:
    """What a plan will ask for and cost, before anything is asked: requests, tokens and dollars for each role."""
    n, e = plan.per_domain * domains, plan.estimate
    out: dict = {"scenarios": n, "roman_variants": round(n * plan.roman_share)}
    for role, (asked, said, system) in {"generator": ("user_tokens", "output_tokens", "system_tokens"), "verifier": ("verify_user_tokens", "verify_output_tokens", "system_tokens")}.items():
        call = plan.calls.get(role)
        if call is None:
            continue
        requests = math.ceil(n / call.per_request)
        tokens = {
            "input_tokens": n * e.get(asked, 0),
            "output_tokens": n * e.get(said, 0) + requests * e.get("thinking_tokens", 0),
            "cache_read_tokens": max(0, requests - 1) * e.get(system, 0),
            "cache_write_tokens": e.get(system, 0),
        }
        price = plan.prices.get(call.model)
        usd = None if price is None else sum(tokens[c] * p for c, p in zip(COUNTERS, price, strict=True)) / 1e6
        rounded = lambda x: None if x is None else round(x, 6)
        out[role] = {"model": call.model, "requests": requests, "tokens": tokens, "usd": rounded(usd), "usd_batch": rounded(None if usd is None else usd / 2)}
    return out


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: how many single-label rows were scored and right, how many clarifications were right, and the mean ms."""
    scored = F.col("issue").isNotNull()
    return results.agg(
        F.count("*").alias("n"), F.count_if(scored).alias("scored"), F.count_if(scored & (F.col("issue") == F.col("pred"))).alias("right"),
        F.count_if(F.col("asks") == F.col("asked")).alias("clarification_right"), F.avg("ms").alias("mean_ms"),
    )


def latency(df: DataFrame, ms: str, by: list[str] = ()) -> DataFrame:
    """n, p50, p95 and mean of a latency."""
    q = lambda p: F.percentile(ms, F.lit(p))
    return df.groupBy(*by).agg(F.count("*").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.avg(ms).alias("mean"))


# --- prompts


def taxonomy_text(tax: Taxonomy, domain: str, ids: bool = True) -> str:
    """A domain's categories as a prompt shows them; hints of where an exclusion belongs are for people only."""
    lines = [f"# {tax.domains[domain].name}"]
    for c, t in tax.domains[domain].categories.items():
        lines.append(f"- {c}: {t.description}" if ids else f"- {t.description}")
        lines += [f"  yes: {x}" for x in t.include]
        lines += [f"  no: {x.split('->')[0].strip()}" for x in t.exclude]
    return "\n".join(lines)


def with_examples(prompt: str, examples: Iterable[str]) -> str:
    """A prompt whose {examples} are a list of style examples."""
    return prompt.replace("{examples}", "\n".join(f"- {' '.join(x.split())}" for x in examples))


def excerpts(hits: DataFrame, question: str = "question") -> DataFrame:
    """``(question_id, prompt)``: the numbered excerpts of each question by rank, then the question. ``hits`` has question_id,
    question, rank, chunk_id, title and text."""
    one = F.concat(F.lit('<excerpt id="'), F.col("chunk_id"), F.lit('">\n'), F.col("title"), F.lit("\n\n"), F.col("text"), F.lit("\n</excerpt>"))
    grouped = hits.groupBy("question_id", question).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("e")))).alias("_e"))
    body = F.array_join(F.transform("_e", lambda x: x["e"]), "\n")
    return grouped.select("question_id", F.concat(F.lit("<excerpts>\n"), body, F.lit("\n</excerpts>\n\n<question>\n"), F.col(question), F.lit("\n</question>")).alias("prompt"))


#: What messages without a model are made of.
OPENINGS = ["नमस्ते,", "हजुर,", "मलाई सहयोग चाहियो:"]
WORDS = "पसल घर बजार बाटो पानी कलम किताब खबर गाडी चिया छाता जुत्ता झोला टोपी ढोका तरकारी दराज धारा नदी पहाड फूल बत्ती भान्सा माटो यात्रा रूख लुगा वन शहर हात".split()


def rendered(facts: Column, seed: str, key: Column) -> Column:
    """A message without a model, in Devanagari: an opening, a few words, what the facts say in numbers, and a closing
    sentence. The same key gives the same message, other keys give others."""
    draw = lambda what, values: F.get(F.array(*map(F.lit, values)), F.floor(uniform(f"{seed}:{what}", key) * len(values)).cast("int"))
    told = F.array_join(F.filter(F.map_values(facts), lambda v: v.rlike("^[0-9]+$")), ", ")
    return F.concat_ws(" ", draw("opening", OPENINGS), *(draw(f"word{i}", WORDS) for i in range(8)), F.when(told != "", F.concat(F.lit("रु "), told)), F.lit("मेरो काम भएको छैन।"))


def option_text(name: Column, description: Column) -> Column:
    """An option as a model reads it: name and description, the name alone without one."""
    return F.when(F.coalesce(description, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(": "), description))


def model_row(state: Column, question: Column, options: Column) -> Column:
    """The text of a model's input, its parts between delimiters that no part can contain."""
    safe = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"<\|([^|]*)\|>", "<¦$1¦>")
    listed = F.array_join(F.transform(options, lambda o: F.concat(F.lit("<|opt|>"), safe(o), F.lit("<|end|>"))), "")
    return F.concat(F.lit("<|state|>"), safe(state), F.lit("<|q|>"), safe(question), listed, F.lit("<|decide|>"))


def version(run: Column, revision: Column) -> Column:
    """A model's version: the run and the first seven characters of its revision."""
    return F.when(revision.isNull(), run).otherwise(F.concat(run, F.lit("@"), F.left(revision, F.lit(7))))


def shown(value: Column, digits: int = 3, percent: bool = False) -> Column:
    """A number for a report; n/a for none, inf for an infinite one."""
    text = F.format_string(f"%.{digits}f%%" if percent else f"%.{digits}f", value * 100 if percent else value)
    return F.when(value.isNull() | F.isnan(value), "n/a").when(F.abs(value) == float("inf"), "inf").otherwise(text)


# --- presets


def presets(records: DataFrame, slots: list[tuple[str, str]], longest: int = 260, group: str = "scenario_group_id") -> DataFrame:
    """``(domain, slot, record_id)``: for each domain, in the order of the slots, the first record by id that fits a slot's
    family and origin, is not too long and whose group is not used yet.

    Slots depend on earlier ones, so they are filled one after another; for that only the first records of each slot and
    group count, of which as many as there are slots can be needed, so each domain's task gets slots squared rows."""
    fits = None
    for k, (family, wanted) in enumerate(slots):
        f = F.col("difficulty_family")
        here = (F.col("origin") == wanted) & ((f == family) | f.startswith(f"{family}:"))
        fits = F.when(here, F.array(F.lit(k))) if fits is None else F.concat(F.coalesce(fits, F.array().cast("array<int>")), F.when(here, F.array(F.lit(k))).otherwise(F.array().cast("array<int>")))
    short = records.where(F.length("message") <= longest).select("domain", "record_id", F.col(group).alias("grp"), F.explode(fits).alias("slot"))
    firsts = short.groupBy("domain", "slot", "grp").agg(F.min("record_id").alias("record_id"))
    from pyspark.sql import Window

    near = firsts.withColumn("_k", F.row_number().over(Window.partitionBy("domain", "slot").orderBy("record_id"))).where(F.col("_k") <= len(slots)).drop("_k")
    listed = near.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("slot", "record_id", "grp"))).alias("c"))
    empty = F.array().cast("array<struct<slot:int,record_id:string,grp:string>>")

    def take(got: Column, x: Column) -> Column:
        free = ~F.exists(got, lambda g: (g["slot"] == x["slot"]) | (g["grp"] == x["grp"]))
        return F.when(free, F.concat(got, F.array(x))).otherwise(got)

    return listed.select("domain", F.explode(F.aggregate("c", empty, take)).alias("g")).select("domain", "g.slot", "g.record_id")


def preset_origin(generator: Column, prompt_version: Column) -> Column:
    """The origin as presets name it."""
    return F.when(generator == "romanize", "translated").when(F.coalesce(prompt_version, F.lit("")).startswith("generate_realstyle"), "app-review").otherwise("clean")
