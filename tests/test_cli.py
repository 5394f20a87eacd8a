"""The commands from a plan to a report, offline, and the loaders of their configuration."""

import json

import pytest

from granary import cli
from granary.operators import rag
from granary.sources import configs
from granary.sources import records as S

TAXONOMY = {
    "version": "t-1",
    "fallback": "other",
    "questions": {
        "issue": {"instructions": ["What is this {domain} message about?", "Sort this {domain} message."]},
        "clarification": {"instructions": ["Is this {domain} message unclear?"], "criteria": {"true": "unclear", "false": "clear"}},
    },
    "domains": {
        "shop": {
            "name": "the shop", "ne": "पसल",
            "categories": {
                "late": {"description": "Order is late", "facts": ["order_id"], "neighbors": ["lost"], "exclude": ["lost parcels -> lost"]},
                "lost": {"description": "Order is lost", "neighbors": ["late"]}, "refund": {"description": "Refund is missing"}, "other": {"description": "Anything else"},
            },
            "contrasts": [["late", "lost", "whether it moved"]],
        }
    },
}
PLAN = {
    "name": "p", "taxonomy_version": "t-1", "seed": 7, "per_domain": 60, "roman_share": 0.5,
    "families": {"single": 0.5, "contrast": 0.2, "vague": 0.1, "negation": 0.2},
    "style": {"length": {"short": 1.0}, "tone": {"calm": 1.0}, "formality": {"plain": 1.0}},
    "calls": {"generator": {"provider": "dry_run", "model": "m", "per_request": 7}, "verifier": {"provider": "dry_run", "model": "m", "per_request": 10}},
    "prices": {"m": [4, 20, 0.2, 5]}, "estimate": {"user_tokens": 10, "output_tokens": 20, "system_tokens": 100, "verify_user_tokens": 5, "verify_output_tokens": 6, "thinking_tokens": 1},
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "tax").mkdir()
    (tmp_path / "tax" / "t-1.json").write_text(json.dumps(TAXONOMY), encoding="utf-8")
    (tmp_path / "base.json").write_text(json.dumps({k: v for k, v in PLAN.items() if k != "seed"} | {"roman_share": 0.1}), encoding="utf-8")
    (tmp_path / "plan.json").write_text(json.dumps({"extends": "base.json", "seed": 7, "roman_share": 0.5}), encoding="utf-8")
    (tmp_path / "rules.json").write_text(json.dumps({"domains": {"shop": {"late": ["late", ["order", "days"]], "lost": ["lost"], "refund": [{"all": ["refund"], "weight": 2}], "other": []}}}), encoding="utf-8")
    (tmp_path / "tables.yaml").write_text("loanwords: {}\nprobabilities: {english_levels: {none: [1.0, 0.0]}}\n", encoding="utf-8")
    return tmp_path


def test_from_plan_to_report(spark, folder):
    at = lambda *names: {"tax": f"{folder}/tax", "plan": f"{folder}/plan.json", "out": f"{folder}/out"}[names[0]] if len(names) == 1 else str(folder.joinpath(*names))
    run = lambda *a: cli.main(list(a), spark)
    assert run("taxonomy", "--taxonomies", at("tax"), "--version", "t-1")["domains"] == {"shop": 4}
    e = run("estimate", "--config", at("plan"), "--taxonomies", at("tax"))
    assert e["generator"]["requests"] == 9 and e["roman_variants"] == 30
    assert e["generator"]["usd"] == round((600 * 4 + (1200 + 9) * 20 + 800 * 0.2 + 100 * 5) / 1e6, 6)
    done = run("pipeline", "--config", at("plan"), "--taxonomies", at("tax"), "--tables", at("", "tables.yaml"), "--out", at("out"))
    assert done["scenarios"]["scenarios"] == done["generate"]["rendered"] == done["records"]["records"] == 60
    assert done["verify"]["mock"] == 60 and done["validate"]["n"] == 60
    accepted = done["validate"]["status"].get("accepted", 0)
    splits = done["split"]["splits"]
    assert accepted > 10 and sum(s["records"] for s in splits.values()) == done["romanize"]["records"] >= accepted
    assert sum(s["requests"] for s in done["export"]["splits"].values()) == done["romanize"]["records"]
    assert done["split"]["leaking_groups"] == 0
    again = run("generate", "--config", at("plan"), "--taxonomies", at("tax"), "--out", at("out"))
    assert again == {"rendered": 0}
    run("baseline-rules", "--rules", at("", "rules.json"), "--splits", at("", "out", "splits"), "--out", at("", "pred"), "--part", "train")
    got = run("evaluate", "--splits", at("", "out", "splits"), "--predictions", f"rules={folder}/pred", "--out", at("", "eval"), "--part", "train")
    assert 0 <= got["train"]["rules"] <= 1 and "| rules |" in (folder / "eval" / "report.md").read_text()
    run("model-card", "--report", f"{folder}/eval/report.json", "--predictor", "rules", "--part", "train", "--base", "tiny-0.8B", "--note", "n", "--code", "c", "--out", f"{folder}/card.md")
    assert "(0.8B)" in (folder / "card.md").read_text()
    assert run("presets", "--taxonomies", at("tax"), "--version", "t-1", "--test", at("", "out", "splits", "train"), "--out", at("", "demo"))["presets"] > 0


def test_paid_calls_need_a_yes(spark, folder, monkeypatch):
    monkeypatch.setenv("GRANARY_GENERATOR_PROVIDER", "hosted")
    assert configs.load_generation(folder / "plan.json").calls["generator"].provider == "hosted"
    cli.main(["scenarios", "--config", f"{folder}/plan.json", "--taxonomies", f"{folder}/tax", "--out", f"{folder}/o"], spark)
    with pytest.raises(SystemExit, match="say --yes"):
        cli.main(["generate", "--config", f"{folder}/plan.json", "--taxonomies", f"{folder}/tax", "--out", f"{folder}/o"], spark)


@pytest.mark.parametrize("change", [{"fallback": "none"}, {"version": "t-2"}, {"questions": TAXONOMY["questions"] | {"issue": {"instructions": ["What?"]}}}])
def test_unsound_taxonomies(folder, change):
    (folder / "tax" / "bad.json").write_text(json.dumps(TAXONOMY | {"version": "bad"} | change), encoding="utf-8")
    with pytest.raises(ValueError):
        configs.load_taxonomy.__wrapped__(f"{folder}/tax", "bad")


def test_small_documents(spark, folder):
    (folder / "rag.yaml").write_text("embedder: bag\n# tuned\nmin_score: 0.2  # by hand\ntop_k: 3\n", encoding="utf-8")
    configs.set_min_score(folder / "rag.yaml", 0.81234)
    assert configs.load_retrieval(folder / "rag.yaml") == configs.Retrieval("bag", 0.8123, 3)
    assert "# by hand" in (folder / "rag.yaml").read_text() and "# tuned" in (folder / "rag.yaml").read_text()
    (folder / "x.json").write_text('["a  b", "c"]')
    assert configs.load_examples(folder / "x.json") == ["a b", "c"]
    assert configs.merged({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2]}) == {"a": {"b": 3, "c": 2}, "d": [2]}
    (folder / "q.jsonl").write_text('{"question_id":"1","domain":"d","script":"en","question":"?","gold_doc_ids":["a"],"must_refuse":false}\n\n{"question_id":"2","domain":"d","script":"en","question":"?","gold_doc_ids":[],"must_refuse":false}\n')
    with pytest.raises(Exception, match="needs gold documents"):
        S.load_questions(spark, f"{folder}/q.jsonl").collect()
    (folder / "bad.jsonl").write_text('{"question_id":"1"}\n\nnot json\n')
    assert S.first_fault(spark, f"{folder}/bad.jsonl").endswith("bad.jsonl:3")
    assert S.first_fault(spark, f"{folder}/q.jsonl") is None
    assert S.read_or_empty(spark, f"{folder}/none", S.QUESTION).count() == 0
    assert rag.gate_holds({"a": 0.5, "b": 0.4}, {"a": 0.5, "b": 0.41, "c": 0.1}) == ["b", "c"]
