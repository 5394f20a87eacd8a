"""The command line: ``python -m granary.cli COMMAND``. Each command reads and writes folders of JSON lines.

Commands that would ask a model run the offline provider; other providers are registered by the program that has them,
and are asked only with --yes."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import registry, reports
from granary.functions.hashing import uniform
from granary.operators import assembling as A
from granary.operators import evaluating as E
from granary.operators import validation as V
from granary.operators.exporting import candidates, request_json, wording
from granary.operators.mixing import build_splits, write_splits
from granary.operators.records import pending
from granary.operators.sampling import spread, stratified
from granary.operators.scenarios import Category, Domain, Plan, scenarios
from granary.operators.splits import SPLITS
from granary.operators.variants import derive_roman, operation_counts
from granary.sources import configs
from granary.sources import records as S
from granary.sources.jsonlines import file_digests, read_lines, write_indexed, write_lines

_commands: dict[str, tuple[Callable, list]] = {}


def command(*arguments: str):
    """Register a command; an argument ends in ? if it may be left out, in ! if it is a switch."""

    def add(f: Callable) -> Callable:
        _commands[f.__name__.replace("_", "-")] = (f, list(arguments))
        return f

    return add


def _write_text(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def _plan(a) -> tuple[configs.Generation, configs.Taxonomy]:
    plan = configs.load_generation(a.config)
    return plan, configs.load_taxonomy(a.taxonomies, plan.taxonomy_version)


def _provider(plan: configs.Generation, role: str, yes: bool, waiting: DataFrame):
    """The role's provider. One that costs money is asked only with --yes, unless nothing is waiting."""
    name = plan.calls[role].provider if role in plan.calls else "dry_run"
    if name != "dry_run" and not yes and not waiting.isEmpty():
        raise SystemExit(f"{role} would ask {name}; say --yes")
    return registry.get("provider", name)


def _limited(df: DataFrame, key: str, limit: str | None) -> DataFrame:
    return df.orderBy(key).limit(int(limit)) if limit else df


@command("taxonomies", "version")
def taxonomy(spark, a):
    t = configs.load_taxonomy(a.taxonomies, a.version)
    return {"version": t.version, "domains": {d: len(s.categories) for d, s in t.domains.items()}, "contrasts": {d: len(s.contrasts) for d, s in t.domains.items()}}


@command("config", "taxonomies")
def estimate(spark, a):
    plan, tax = _plan(a)
    return A.estimate(plan, len(tax.domains))


def _sampled(spark, plan: configs.Generation, tax: configs.Taxonomy) -> DataFrame:
    domains = {d: Domain({c: Category(t.description, t.facts, t.neighbors) for c, t in s.categories.items()}, tax.fallback, s.contrasts) for d, s in tax.domains.items()}
    made = scenarios(spark, domains, Plan(plan.name, str(plan.seed), plan.per_domain, plan.families, plan.style))
    traits = [c for c in ("length", "tone", "formality")]
    missing = [F.lit("plain").alias(c) for c in traits if c not in made.columns]
    style = F.struct(*(c for c in traits if c in made.columns), *missing)
    return made.withColumn("style", style).drop(*traits).withColumn("taxonomy_version", F.lit(tax.version))


@command("config", "taxonomies", "out")
def scenarios_(spark, a):
    plan, tax = _plan(a)
    n = write_lines(_sampled(spark, plan, tax), f"{a.out}/scenarios")
    back = read_lines(spark, f"{a.out}/scenarios", S.SCENARIO)
    count = lambda c: {r[0]: r[1] for r in back.groupBy(F.coalesce(c, F.lit("(clarify)"))).count().collect()}
    return {"scenarios": n, "families": count(F.split_part("family", F.lit(":"), F.lit(1))), "issues": count(F.col("issue"))}


_commands["scenarios"] = _commands.pop("scenarios-")


def _same_scenarios(spark, a, plan, tax) -> DataFrame:
    """The stored scenarios, which must be those that the plan samples now."""
    stored, now = read_lines(spark, f"{a.out}/scenarios", S.SCENARIO), _sampled(spark, plan, tax)
    key = lambda df: df.select("scenario_id", "family", "instructions")
    if not (key(stored).exceptAll(key(now)).isEmpty() and key(now).exceptAll(key(stored)).isEmpty()):
        raise SystemExit("the stored scenarios are not those of this plan; write them anew")
    return stored


@command("config", "taxonomies", "out", "limit?", "yes!")
def generate(spark, a):
    plan, tax = _plan(a)
    waiting = _limited(pending(_same_scenarios(spark, a, plan, tax), S.read_or_empty(spark, f"{a.out}/raw", S.RENDERING), ["scenario_id"]), "scenario_id", a.limit)
    return {"rendered": S.append(_provider(plan, "generator", a.yes, waiting).render(waiting), f"{a.out}/raw")}


@command("config", "taxonomies", "out")
def records(spark, a):
    plan, tax = _plan(a)
    raw = read_lines(spark, f"{a.out}/raw", S.RENDERING)
    return {"records": write_lines(A.build_records(read_lines(spark, f"{a.out}/scenarios", S.SCENARIO), raw, "line", plan.seed), f"{a.out}/records")}


def _judge(spark, a, role: str, rows: DataFrame) -> dict:
    plan = configs.load_generation(a.config)
    path = f"{a.out}/{role}"
    waiting = pending(rows, S.read_or_empty(spark, path, S.VERDICT), ["record_id"])
    n = S.append(_provider(plan, role, a.yes, waiting).judge(waiting), path)
    merged = A.merge_verdicts(S.load_records(spark, f"{a.out}/records").drop(f"{role}_agrees"), read_lines(spark, path, S.VERDICT), "line")
    write_lines(merged.withColumnRenamed("agrees", f"{role}_agrees").drop("judge"), f"{a.out}/judged-{role}")
    return {"asked": n} | A.verdict_counts(merged).first().asDict()


@command("config", "out", "yes!")
def verify(spark, a):
    return _judge(spark, a, "verifier", S.load_records(spark, f"{a.out}/records"))


@command("config", "out", "yes!")
def adjudicate(spark, a):
    disputed = S.load_records(spark, f"{a.out}/judged-verifier").where(F.col("verifier_agrees").eqNullSafe(F.lit(False)))
    return _judge(spark, a, "adjudicator", disputed)


@command("taxonomies", "version", "records", "out", "near?", "strict!")
def validate(spark, a):
    tax = configs.load_taxonomy(a.taxonomies, a.version)
    done = V.validate(S.load_records(spark, a.records).drop("status", "reason"), tax, "record_id", float(a.near or 0.85))
    write_lines(done.drop("findings", "duplicate_of"), f"{a.out}/validated")
    report = reports.validation_json(done, tax)
    _write_text(f"{a.out}/validation.json", report)
    if a.strict and json.loads(report).get("status", {}).get("rejected"):
        raise SystemExit("some records were rejected")
    return json.loads(report)


@command("tables", "config", "records", "out")
def romanize(spark, a):
    from granary.functions.romanize import load_tables

    plan = configs.load_generation(a.config)
    base = S.load_records(spark, a.records).where("status = 'accepted'")
    made = derive_roman(base, load_tables(a.tables), plan.roman_share, str(plan.seed), [("too_short", F.length("message") < V.SHORTEST), ("too_long", F.length("message") > V.LONGEST)])
    kept = made.where("status = 'accepted'").withColumn("derivation", F.struct(F.col("parent_id").alias("parent_record_id"), "ops"))
    n = write_lines(base.unionByName(kept.select(base.columns)), f"{a.out}/with-roman")
    return {"records": n, "ops": {r["op"]: r["n"] for r in operation_counts(made).collect()}}


@command("config", "out", "clean", "share?", "sample?", "limit?", "yes!")
def realstyle_generate(spark, a):
    plan = configs.load_generation(a.config)
    kept = A.accepted_scenarios(read_lines(spark, f"{a.out}/scenarios", S.SCENARIO), S.load_records(spark, a.clean), V.origin())
    key = F.col("scenario_id")
    if a.sample:
        chosen = spread(kept, ["domain", "family"], uniform(f"{plan.seed}:style", key), uniform(f"{plan.seed}:bucket", F.col("domain"), F.col("family")), "scenario_id", int(a.sample))
        kept = kept.join(chosen, "scenario_id", "left_semi")
    bucket = kept.withColumn("label", F.coalesce("issue", F.split_part("family", F.lit(":"), F.lit(1))))
    scripts = stratified(bucket, ["domain", "label"], uniform(f"{plan.seed}:script", key), "scenario_id", float(a.share or 0.5), uniform(f"{plan.seed}:round", F.col("domain"), F.col("label")))
    write_lines(scripts.select("scenario_id", F.when(F.col("chosen"), "deva").otherwise("roman").alias("script")), f"{a.out}/scripts")
    waiting = _limited(pending(kept, S.read_or_empty(spark, f"{a.out}/realstyle-raw", S.RENDERING), ["scenario_id"]), "scenario_id", a.limit)
    return {"rendered": S.append(_provider(plan, "realstyle", a.yes, waiting).render(waiting), f"{a.out}/realstyle-raw")}


@command("config", "out")
def realstyle_records(spark, a):
    plan = configs.load_generation(a.config)
    scripts = read_lines(spark, f"{a.out}/scripts", "scenario_id STRING, script STRING").withColumnRenamed("script", "_script")
    s = read_lines(spark, f"{a.out}/scenarios", S.SCENARIO).join(scripts, "scenario_id")
    made = A.build_records(s, read_lines(spark, f"{a.out}/realstyle-raw", S.RENDERING), "line", plan.seed, F.col("_script"))
    return {"records": write_lines(made, f"{a.out}/realstyle-records")}


@command("clean", "out", "realstyle?", "external?", "seed?")
def split(spark, a):
    clean = S.load_records(spark, a.clean).where("coalesce(status, 'accepted') = 'accepted'")
    realstyle = S.load_records(spark, a.realstyle).where("coalesce(status, 'accepted') = 'accepted'") if a.realstyle else clean.limit(0)
    external = {}
    for part in (a.external or "").split(","):
        if part:
            name, _, path = part.partition("=")
            external[name] = S.load_records(spark, path)
    placed, unplaced = build_splits(clean, realstyle, external, "record_id", a.seed or "0")
    inputs = {"clean": a.clean} | ({"realstyle": a.realstyle} if a.realstyle else {})
    return write_splits(placed, unplaced, inputs, a.seed or "0", a.out)


@command("taxonomies", "version", "splits", "out", "seed?")
def export(spark, a):
    tax, seed = configs.load_taxonomy(a.taxonomies, a.version), a.seed or "0"
    manifest: dict = {"seed": seed, "taxonomy": tax.version, "splits": {}}
    for name, _ in SPLITS:
        rows, train = S.load_records(spark, f"{a.splits}/{name}"), name == "train"
        made = None
        for d in tax.domains:
            key, label = F.col("record_id"), F.col("labels.issue")
            say = ([tax.question("issue", d, i) for i in range(len(tax.issue_questions))], [tax.question("clarification", d, i) for i in range(len(tax.clarification_questions))])
            variants = (wording(len(say[0]), key, f"{seed}:q1", train), wording(len(say[1]), key, f"{seed}:q2", train))
            body = request_json(F.col("message"), candidates(tax.categories(d), tax.fallback, label, key, seed, train), tax.criteria(d), say, variants, label, F.col("labels.issue_target"), F.col("labels.clarification_needed"), tax.clarification_criteria)
            part = rows.where(F.col("domain") == d).select("record_id", "scenario_group_id", body.alias("body"))
            made = part if made is None else made.union(part)
        n = write_indexed(made, "record_id", "body", ["record_id", "scenario_group_id"], f"{a.out}/{name}")
        manifest["splits"][name] = {"requests": n, "sha256": sorted(r["sha256"] for r in file_digests(spark, f"{a.out}/{name}/lines").where("path LIKE '%part-%'").collect())}
    _write_text(f"{a.out}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


@command("rules", "splits", "out", "part?")
def baseline_rules(spark, a):
    router = registry.get("router", "rules", rules=configs.load_rules(a.rules))
    out = {}
    for name in (a.part or "calib,test").split(","):
        routed = router(S.load_records(spark, f"{a.splits}/{name}"))
        out[name] = write_lines(routed.select("record_id", "names", "p", "said", "rule"), f"{a.out}/{name}")
    return out


@command("splits", "predictions", "out", "part?")
def evaluate(spark, a):
    """``predictions`` is name=folder, comma-separated; each folder has a folder for each part."""
    shape = "record_id STRING, names ARRAY<STRING>, p ARRAY<DOUBLE>, said DOUBLE"
    texts, numbers = [], {}
    for part in (a.part or "test").split(","):
        rows = S.load_records(spark, f"{a.splits}/{part}")
        named = {}
        for said in a.predictions.split(","):
            name, _, path = said.partition("=")
            named[name] = E.pairs(rows, read_lines(spark, f"{path}/{part}", shape)).where("origin <> 'external'")
        text, numbers[part] = reports.evaluation(named, part)
        texts.append(text)
    _write_text(f"{a.out}/report.md", "\n".join(texts))
    _write_text(f"{a.out}/report.json", json.dumps(numbers, default=str, sort_keys=True))
    return {part: {n: x["issue"]["accuracy"] for n, x in found.items()} for part, found in numbers.items()}


@command("report", "predictor", "part", "base", "note", "code", "out")
def model_card(spark, a):
    numbers = json.loads(Path(a.report).read_text(encoding="utf-8"))[a.part][a.predictor]
    _write_text(a.out, reports.model_card(a.predictor, a.base, numbers, a.note, a.code))
    return {"card": a.out}


@command("taxonomies", "version", "test", "out")
def presets(spark, a):
    tax = configs.load_taxonomy(a.taxonomies, a.version)
    rows = S.load_records(spark, a.test).withColumn("origin", A.preset_origin(F.when(F.col("derivation").isNotNull(), "romanize").otherwise(F.col("source.generator")), F.col("source.prompt_version")))
    slots = [(f, o) for f in ("single", "contrast", "negation", "corrected_statement", "out_of_scope", "vague") for o in ("clean", "translated")]
    _write_text(f"{a.out}/taxonomy.json", reports.taxonomy_json(tax))
    text = reports.presets_json(A.presets(rows, slots), rows)
    _write_text(f"{a.out}/presets.json", text)
    return {"presets": len(json.loads(text))}


@command("config", "taxonomies", "tables", "out", "yes!")
def pipeline(spark, a):
    """From scenarios to exported requests, with the offline provider unless the plan names another."""
    plan, _ = _plan(a)
    a.version, a.records, a.near, a.strict, a.limit, a.realstyle, a.external, a.seed = plan.taxonomy_version, f"{a.out}/judged-verifier", None, False, None, None, None, str(plan.seed)
    done = {}
    for name in ("scenarios", "generate", "records", "verify", "validate"):
        done[name] = _commands[name][0](spark, a)
    a.records = f"{a.out}/validated"
    done["romanize"] = romanize(spark, a)
    a.clean, root = f"{a.out}/with-roman", a.out
    a.out = a.splits = f"{root}/splits"
    done["split"] = split(spark, a)
    a.out = f"{root}/export"
    done["export"] = export(spark, a)
    return done


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="granary")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in sorted(_commands.items()):
        p = sub.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for x in arguments:
            if x.endswith("!"):
                p.add_argument(f"--{x[:-1]}", action="store_true")
            else:
                p.add_argument(f"--{x.rstrip('?')}", required=not x.endswith("?"))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(arguments)
    found = _commands[a.command][0](spark or SparkSession.builder.appName(f"granary {a.command}").getOrCreate(), a)
    print(json.dumps(found, ensure_ascii=False, default=str), file=sys.stdout)
    return found


if __name__ == "__main__":
    main()
