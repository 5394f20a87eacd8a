"""Retrieved chunks are written once, and what is measured on them embeds nothing again."""

from granary.plans import assembly


def test_answers_embed_once(spark):
    for name in ("answer_metrics", "answer_prompts", "retrieval_by_script"):
        plan = getattr(assembly, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "conv(substr" not in plan and "regexp_extract_all" not in plan
