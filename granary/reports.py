"""Reports as Markdown and JSON, from aggregates that are small by their nature."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import evaluating as E
from granary.operators import rag as R
from granary.operators import validation as V
from granary.operators.retrieval import auc


def number(x, digits: int = 3) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "n/a"
    if isinstance(x, float):
        return "inf" if math.isinf(x) else f"{x:.{digits}f}"
    return str(x)


def table(head: Iterable[str], rows: Iterable[Iterable]) -> str:
    head = list(head)
    cells = [[number(x) for x in row] for row in rows]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(r) + " |" for r in cells)]) + "\n"


def validation_json(validated: DataFrame, tax, enough: int = V.ENOUGH) -> str:
    out: dict = {"n": 0}
    for r in V.report(validated).collect():
        part = out.setdefault(r["section"], {})
        if r["domain"] is not None:
            part = part.setdefault(r["domain"], {})
        part[str(r["key"])] = r["n"]
    out["n"] = sum(out.get("status", {}).values())
    out["warnings"] = sorted(f"{r['domain']}/{r['category']}: {r['n']} of {r['total']} accepted" for r in V.warnings(validated, tax, enough).collect())
    return json.dumps(out, ensure_ascii=False, sort_keys=True)


def evaluation(pairs: Mapping[str, DataFrame], split: str) -> tuple[str, dict]:
    """(Markdown, numbers) of several predictors on one split: summary, slices and bias."""
    numbers, rows, sliced, bias = {}, [], [], []
    for name, df in pairs.items():
        issue, ask = E.issue_summary(df).first().asDict(), E.clarification_summary(df).first().asDict()
        numbers[name] = {"issue": issue, "clarification": ask, "slices": [r.asDict() for r in E.slices(df).collect()], "bias": [r.asDict() for r in E.bias_verdicts(df).collect()]}
        rows.append([name, issue["accuracy"], issue["macro_f1"], issue["nll"], issue["brier"], issue["ece"], issue["coverage"], ask["f1"]])
        sliced += [[name, s["slice"], s["key"], s["n"], s["issue_accuracy"], s["clarification_f1"]] for s in sorted(numbers[name]["slices"], key=lambda s: (s["slice"], str(s["key"])))]
        bias += [[name, b["verdict"], {True: "pass", False: "fail", None: "n/a"}[b["passed"]], b["value"], b["checked"]] for b in numbers[name]["bias"]]
    text = f"## {split}\n\n" + table(["predictor", "accuracy", "macro F1", "NLL", "Brier", "ECE", "coverage", "clarification F1"], rows)
    text += "\n" + table(["predictor", "slice", "key", "n", "accuracy", "clarification F1"], sliced) + "\n" + table(["predictor", "check", "verdict", "value", "checked"], bias)
    return text, numbers


def retrieval(ranked: DataFrame, threshold: float, answers: DataFrame | None = None) -> tuple[str, dict]:
    """(Markdown, numbers) of a retrieval evaluation: ranks by script, the gate, and the answers' metrics if given."""
    by = [r.asDict() for r in R.retrieval_by(ranked, "script").collect()]
    gate = R.gate(ranked, threshold).first().asDict()
    text = table(["script", "n", "recall@1", "recall@3", "recall@5", "MRR"], [list(r.values()) for r in sorted(by, key=lambda r: r["script"])])
    text += "\n" + table(["refusal precision", "refusal recall", "answerable kept"], [list(gate.values())])
    out = {"retrieval": by, "gate": gate}
    if answers is not None:
        out["answers"] = answers.first().asDict()
        text += "\n" + table(["answer metric", "value"], list(out["answers"].items()))
    return text, out


def compare_embedders(questions: DataFrame, chunks: DataFrame, embedders: Iterable[R.Embedder], k: int = 10) -> tuple[str, list[dict]]:
    """(Markdown, rows): recall, MRR and how well the best score tells what must be refused, for each embedder."""
    rows = []
    for e in embedders:
        stored = chunks.withColumn("embedding", e.passages(F.col("text")))
        hits = R.retrieve(questions, stored, e, k).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
        ranked = R.ranks(questions, hits)
        whole = R.retrieval_by(ranked, "script").where("script = 'all'").first()
        told = auc(ranked.where("best IS NOT NULL").select("best", (~F.col("must_refuse")).alias("ok")), "best", "ok").first()["auc"]
        rows.append({"embedder": e.name, "dim": e.dim, "recall_5": whole["recall_5"], "mrr": whole["mrr"], "refusal_auc": told})
    return table(["embedder", "dimensions", "recall@5", "MRR", "refusal AUC"], [list(r.values()) for r in rows]), rows


def model_card(name: str, base: str, numbers: dict, note: str, code: str) -> str:
    """A model's card: what it is, what it was measured at, and what its data were."""
    size = next((x for x in reversed(base.replace("-", " ").replace("_", " ").split()) if x[-1:] in "BbMm" and x[:-1].replace(".", "").isdigit()), "n/a")
    issue, ask = numbers["issue"], numbers["clarification"]
    rows = [["accuracy", issue["accuracy"]], ["macro F1", issue["macro_f1"]], ["ECE", issue["ece"]], ["clarification F1", ask["f1"]]]
    return f"# {name}\n\nBase: {base} ({size})\n\nCode: {code}\n\n{note}\n\n" + table(["metric", "value"], rows)


def taxonomy_json(tax) -> str:
    """The taxonomy as a page needs it."""
    domains = {
        d: {
            "name": s.name, "ne": s.ne,
            "issue": {"type": "choice", "instructions": tax.question("issue", d), "criteria": tax.criteria(d)},
            "clarification": {"type": "noul", "instructions": tax.question("clarification", d), "criteria": tax.clarification_criteria},
            "names_ne": {c: t.ne for c, t in s.categories.items()},
        }
        for d, s in tax.domains.items()
    }
    return json.dumps({"version": tax.version, "fallback": tax.fallback, "domains": domains}, ensure_ascii=False)


def presets_json(presets: DataFrame, records: DataFrame) -> str:
    """Presets in the order of domains and slots, each with its record."""
    rows = presets.join(records, ["domain", "record_id"]).orderBy("domain", "slot").select("domain", "record_id", "message", "script", "origin", F.col("difficulty_family").alias("family"), "labels.issue", "issues_all", F.col("labels.clarification_needed").alias("clarification"))
    return json.dumps([r.asDict() for r in rows.collect()], ensure_ascii=False)
