"""Configuration that drives the engine: taxonomies, keyword rules, generation plans and retrieval settings.

All of these are small documents read on the driver; what queries need of them becomes dimension tables or literals.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.scenarios import FAMILIES


def read_document(path: str | Path) -> dict | list:
    """A YAML or JSON document. YAML needs a parser, which is asked for only where a file needs it."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


# --- taxonomy


@dataclass(frozen=True)
class Topic:
    """A category as the configuration describes it."""

    description: str
    ne: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    neighbors: tuple[str, ...] = ()
    facts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Service:
    name: str
    ne: str
    categories: dict[str, Topic]
    contrasts: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class Taxonomy:
    """Services, their categories, and the questions asked about a message. Its parts refer to each other soundly."""

    version: str
    fallback: str
    issue_questions: tuple[str, ...]
    clarification_questions: tuple[str, ...]
    clarification_criteria: dict[str, str]
    domains: dict[str, Service]

    def __post_init__(self) -> None:
        wrong = []
        for name, d in self.domains.items():
            known = set(d.categories)
            if self.fallback not in known:
                wrong.append(f"{name} has no fallback category {self.fallback}")
            for c, topic in d.categories.items():
                wrong += [f"{name}/{c} names the unknown neighbour {x}" for x in topic.neighbors if x not in known]
            wrong += [f"{name} contrasts the unknown category {x}" for a, b, _ in d.contrasts for x in (a, b) if x not in known]
        wrong += [f"a question does not name its service: {q}" for q in self.issue_questions + self.clarification_questions if "{domain}" not in q]
        if not self.issue_questions or not self.clarification_questions:
            wrong.append("each question needs a wording")
        if set(self.clarification_criteria) != {"true", "false"}:
            wrong.append("clarification criteria are exactly true and false")
        if wrong:
            raise ValueError("; ".join(wrong))

    def categories(self, domain: str) -> list[str]:
        if domain not in self.domains:
            raise KeyError(f"no domain {domain!r}, only {sorted(self.domains)}")
        return list(self.domains[domain].categories)

    def criteria(self, domain: str) -> dict[str, str]:
        return {c: self.domains[domain].categories[c].description for c in self.categories(domain)}

    def question(self, kind: str, domain: str, variant: int = 0) -> str:
        """The wording of a question in a variant, with the service's name in it."""
        said = self.issue_questions if kind == "issue" else self.clarification_questions
        return said[variant % len(said)].replace("{domain}", self.domains[domain].name)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(domain, category, ordinal, description, ne, neighbors)``: the dimension that records are looked up in."""
        rows = [
            (d, c, k, t.description, t.ne, list(t.neighbors))
            for d, s in self.domains.items()
            for k, (c, t) in enumerate(s.categories.items())
        ]
        return spark.createDataFrame(rows, "domain string, category string, ordinal int, description string, ne string, neighbors array<string>")

    def said(self, kind: str, domain: Column, variant: Column) -> Column:
        """``question`` as an expression; null for an unknown domain."""
        count = len(self.issue_questions if kind == "issue" else self.clarification_questions)
        out = F.lit(None).cast("string")
        for d in self.domains:
            wordings = F.array(*(F.lit(self.question(kind, d, i)) for i in range(count)))
            out = F.when(domain == d, F.get(wordings, F.pmod(variant, F.lit(count)).cast("int"))).otherwise(out)
        return out


def taxonomy(data: Mapping) -> Taxonomy:
    def many(x) -> tuple:
        return tuple(x or ())

    domains = {
        name: Service(
            d["name"],
            d.get("ne", ""),
            {
                c: Topic(t["description"], t.get("ne", ""), many(t.get("include")), many(t.get("exclude")), many(t.get("neighbors")), many(t.get("facts")))
                for c, t in d["categories"].items()
            },
            tuple(tuple(x) for x in many(d.get("contrasts"))),
        )
        for name, d in data["domains"].items()
    }
    asked = data["questions"]
    return Taxonomy(
        data["version"],
        data["fallback"],
        many(asked["issue"]["instructions"]),
        many(asked["clarification"]["instructions"]),
        {str(k).lower(): v for k, v in asked["clarification"]["criteria"].items()},
        domains,
    )


@cache
def load_taxonomy(folder: str, version: str) -> Taxonomy:
    """The taxonomy of a version, whose file must declare that version."""
    path = next((p for end in ("yaml", "json") if (p := Path(folder) / f"{version}.{end}").exists()), None)
    if path is None:
        raise FileNotFoundError(f"no taxonomy {version} in {folder}")
    found = taxonomy(read_document(path))
    if found.version != version:
        raise ValueError(f"{path} says that it is version {found.version}")
    return found


# --- keyword rules


@cache
def load_rules(path: str) -> dict[str, dict[str, list]]:
    """``{domain: {category: cues}}``; a cue is a string, a list whose members must all occur, or {all, weight}."""
    found = read_document(path)["domains"]
    for domain, rules in found.items():
        for category, cues in rules.items():
            for cue in cues or ():
                terms = cue.get("all") if isinstance(cue, dict) else cue if isinstance(cue, list) else [cue]
                if not terms or not all(isinstance(t, (str, int, float)) for t in terms):
                    raise ValueError(f"{domain}/{category}: not a cue: {cue!r}")
    plain = lambda cue: {**cue, "all": [str(t) for t in cue["all"]]} if isinstance(cue, dict) else [str(t) for t in cue] if isinstance(cue, list) else str(cue)
    return {d: {c: [plain(x) for x in cues or ()] for c, cues in rules.items()} for d, rules in found.items()}


def rules_table(spark: SparkSession, rules: Mapping[str, Mapping[str, Iterable]]) -> DataFrame:
    """``(domain, category, ordinal, terms, weight)``, a row a cue."""
    rows = []
    for domain, by_category in rules.items():
        for k, (category, cues) in enumerate(by_category.items()):
            for cue in cues:
                terms, weight = (cue["all"], cue.get("weight", 1)) if isinstance(cue, dict) else (cue if isinstance(cue, list) else [cue], 1)
                rows.append((domain, category, k, [t.lower() for t in terms], float(weight)))
    return spark.createDataFrame(rows, "domain string, category string, ordinal int, terms array<string>, weight double")


# --- generation


def merged(base, over):
    """``over`` laid upon ``base``: maps merge key by key, anything else replaces what was there."""
    if isinstance(base, Mapping) and isinstance(over, Mapping):
        return {**base, **{k: merged(base[k], v) if k in base else v for k, v in over.items()}}
    return over


@dataclass(frozen=True)
class Call:
    """A model that is asked, and how much of the work goes into one request."""

    provider: str
    model: str
    prompt: str = ""
    per_request: int = 1


@dataclass(frozen=True)
class Generation:
    name: str
    taxonomy_version: str
    seed: int
    per_domain: int
    families: dict[str, float]
    style: dict[str, dict[str, float]]
    roman_share: float = 0.0
    calls: dict[str, Call] = field(default_factory=dict)
    prices: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)
    estimate: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if unknown := set(self.families) - set(FAMILIES):
            raise ValueError(f"unknown families {sorted(unknown)}")
        for name, shares in [("families", self.families), *self.style.items()]:
            if not shares or min(shares.values()) < 0 or abs(sum(shares.values()) - 1) > 1e-6:
                raise ValueError(f"{name} is not a distribution")


def load_generation(path: str | Path, environment: Mapping[str, str] | None = None) -> Generation:
    """A plan; ``extends`` names a file beside it that it is laid upon. GRANARY_<ROLE>_<PROVIDER or MODEL> override a call."""
    path = Path(path)
    data = read_document(path)
    seen = {path.resolve()}
    while "extends" in data:
        below = (path.parent / data.pop("extends")).resolve()
        if below in seen:
            raise ValueError(f"{below} extends itself")
        seen.add(below)
        data = merged(read_document(below), data)
    environment = os.environ if environment is None else environment
    calls = {}
    for role, call in (data.get("calls") or {}).items():
        said = {k: environment[f"GRANARY_{role}_{k}".upper()] for k in ("provider", "model") if f"GRANARY_{role}_{k}".upper() in environment}
        calls[role] = Call(**{**call, **said})
    prices = {m: tuple(map(float, p)) for m, p in (data.get("prices") or {}).items()}
    return Generation(
        data["name"], data["taxonomy_version"], int(data["seed"]), int(data["per_domain"]), data["families"], data["style"], float(data.get("roman_share", 0)), calls, prices, data.get("estimate") or {}
    )


def load_examples(path: str | Path) -> list[str]:
    """Style examples: a JSON list of strings, white space collapsed."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise ValueError(f"{path} is not a list of strings")
    return [" ".join(x.split()) for x in found]


# --- retrieval


@dataclass(frozen=True)
class Retrieval:
    embedder: str
    min_score: float
    top_k: int = 5
    prompt: str = "answer"


def load_retrieval(path: str | Path) -> Retrieval:
    data = read_document(path)
    return Retrieval(data["embedder"], float(data["min_score"]), int(data.get("top_k", 5)), data.get("prompt", "answer"))


def set_min_score(path: str | Path, value: float) -> None:
    """Rewrite the one line that sets ``min_score``; everything else in the file, comments too, stays as it is."""
    lines = Path(path).read_text(encoding="utf-8").splitlines(keepends=True)
    places = [i for i, line in enumerate(lines) if line.lstrip().startswith("min_score:")]
    if len(places) != 1:
        raise ValueError(f"{path} sets min_score on {len(places)} lines, not on one")
    old = lines[places[0]]
    note = old[old.index("#") :].rstrip("\n") if "#" in old else ""
    indent = old[: len(old) - len(old.lstrip())]
    lines[places[0]] = f"{indent}min_score: {value:.4f}{'  ' + note if note else ''}" + ("\n" if old.endswith("\n") else "")
    Path(path).write_text("".join(lines), encoding="utf-8")
