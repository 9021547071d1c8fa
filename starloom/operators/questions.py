"""Questions as data: placeholders, identifiers, bindings, same-name ambiguity, a rule-based compiler."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starloom.operators.relational import first_by, top_n

#: Placeholder kinds: names that anybody may invent, and values of closed vocabularies (fixed values).
OPEN_KINDS = (
    "Person_name", "Movie_title", "Serie_title", "Company_name", "Network_name",
    "Character_name", "Location_name", "List_name", "Award_name", "Nomination_name",
    "Collection_name", "Movement_name", "Group_name", "Death_name", "Topic_name",
    "Release_year", "Birth_year", "Death_year",
    "IMDb_ID", "IMDb_person_ID", "Wikidata_ID", "Wikidata_property_ID",
    "TMDb_ID", "Criterion_spine_ID",
)
CLOSED_KINDS = ("Movie_genre", "Serie_genre", "Status_name", "Serie_type", "Department_name", "Technical_format")

#: Kinds whose values must have a form, and whether they are numbers (fixed values).
ID_RULES = {
    "Release_year": (r"\d{4}", True),
    "Birth_year": (r"\d{4}", True),
    "Death_year": (r"\d{4}", True),
    "IMDb_person_ID": (r"nm\d+", False),
    "IMDb_ID": (r"tt\d+", False),
    "Wikidata_property_ID": (r"P\d+", False),
    "Wikidata_ID": (r"Q\d+", False),
    "TMDb_ID": (r"\d+", True),
    "Criterion_spine_ID": (r"\d+", True),
}

ID_PATTERNS = {"title": re.compile(r"tt\d+"), "name": re.compile(r"nm\d+"), "item": re.compile(r"[Qq]\d+")}


def kind_of(placeholder: str) -> str:
    """A placeholder's kind: its name without the number behind it."""
    return re.sub(r"_?\d+$", "", placeholder)


def checked_value(placeholder: str, value) -> str | int | None:
    """The value to bind: a number or text where the kind has a form, None if the value lacks it; other kinds as they are."""
    rule = ID_RULES.get(kind_of(placeholder))
    if rule is None:
        return value
    text = "" if value is None else str(value).strip()
    if not re.fullmatch(rule[0], text):
        return None
    return int(text) if rule[1] else text


def bare_id(text: str) -> tuple[str, str] | None:
    """(kind, id) if the whole question is an identifier."""
    t = text.strip().rstrip("?.!").strip()
    for kind in ("title", "name", "item"):
        if ID_PATTERNS[kind].fullmatch(t):
            return kind, t.upper() if kind == "item" else t
    return None


def lookup_by_precedence(found: list[tuple[str, DataFrame]], key: str, value) -> DataFrame:
    """Rows with the id from the first table that has it."""
    parts = None
    for rank, (kind, df) in enumerate(found):
        x = df.where(F.col(key) == value).select(F.lit(rank).alias("_rank"), F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("row"))
        parts = x if parts is None else parts.unionByName(x)
    w = Window.partitionBy()  # rows of one id
    return parts.withColumn("_best", F.min("_rank").over(w)).where("_rank = _best").drop("_rank", "_best")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    value: str


def align_spans(question: str, anonymised: str, values: dict[str, str]) -> list[Span] | None:
    """Where each placeholder's value stands in the question; None if the texts don't line up."""
    names = re.findall(r"\{\{(\w+)\}\}", anonymised)
    literal = re.split(r"\{\{\w+\}\}", anonymised)
    pattern = re.escape(literal[0]) + "".join(f"({re.escape(values.get(n, ''))}){re.escape(x)}" for n, x in zip(names, literal[1:], strict=True))
    m = re.fullmatch(pattern, question, re.I)
    if m is None or any(n not in values for n in names):
        return None
    return [Span(*m.span(i + 1), n, values[n]) for i, n in enumerate(names)]


def merge_passes(question: str, open_pass: list[Span] | None, closed_pass: list[Span] | None) -> tuple[str, dict[str, str]]:
    """Text with placeholders and their values from two passes; open names win where spans overlap, kinds that a pass doesn't own are left out."""
    kept = [s for s in open_pass or [] if kind_of(s.kind) in OPEN_KINDS]
    kept += [s for s in closed_pass or [] if kind_of(s.kind) in CLOSED_KINDS and all(s.end <= t.start or s.start >= t.end for t in kept)]
    out, at, values = [], 0, {}
    numbers: dict[str, int] = {}
    for s in sorted(kept, key=lambda s: s.start):
        stem = kind_of(s.kind)
        numbers[stem] = numbers.get(stem, 0) + 1
        name = f"{stem}{numbers[stem]}"
        out += [question[at : s.start], "{{" + name + "}}"]
        values[name], at = s.value, s.end
    return "".join(out) + question[at:], values


_HOLDER = re.compile(r"\{\{(\w+)\}\}")


def bind(sql: str, values: dict[str, str | int]) -> tuple[str, dict[str, str | int]]:
    """A SQL text with named parameters, and their arguments.

    ``'{{X}}'`` and ``{{X}}`` become ``:X``; a literal that holds more than the
    placeholder becomes a ``concat``. Values never enter the text, so quotes,
    backslashes and comment marks in them mean nothing. Placeholders without a
    value, or whose value lacks their kind's form, stay in the text.
    """
    found = {k: checked_value(k, v) for k, v in values.items()}
    known = {k for k, v in found.items() if v is not None}
    args: dict[str, str | int] = {}

    def as_text(name: str) -> str:
        args[f"t_{name}"] = str(found[name])
        return f":t_{name}"

    def literal(token: str) -> str:
        parts = _HOLDER.split(token[1:-1])
        if len(parts) == 1 or not set(parts[1::2]) <= known:
            return token
        said = [as_text(p) if i % 2 else token[0] + p + token[0] for i, p in enumerate(parts) if i % 2 or p]
        return said[0] if len(said) == 1 else f"concat({', '.join(said)})"

    def bare(m: re.Match) -> str:
        name = m[1]
        if name not in known:
            return m[0]
        v = found[name]
        if not isinstance(v, int) and not re.fullmatch(r"-?\d{1,18}", str(v)):
            return as_text(name)
        args[f"n_{name}"] = int(v)
        return f":n_{name}"

    out = []
    for token in re.findall(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\{\{\w+\}\}|.", sql, re.S):
        out.append(literal(token) if token[0] in "'\"" and len(token) > 1 else _HOLDER.sub(bare, token) if token[:2] == "{{" else token)
    return "".join(out), args


def unresolved(sql: str) -> list[str]:
    """Placeholders left; a text with any is not to be run."""
    return re.findall(r"\{\{(\w+)\}\}", sql)


def any_language(sql: str, column: str, others: list[str]) -> str:
    """``q.COL = 'x'`` becomes an OR over the columns of all languages, with its qualifier."""

    def spread(m: re.Match) -> str:
        q, value = m[1] or "", m[2]
        return "(" + " OR ".join(f"{q}{c} = {value}" for c in (column, *others)) + ")"

    return re.sub(rf"((?:\w+\.)?)\b{re.escape(column)}\s*=\s*('(?:[^']|'')*')", spread, sql)


def pure_equality(sql: str, column: str) -> str | None:
    """The name, if the text is one SELECT whose only condition is ``column = 'name'``."""
    if len(re.findall(r"\bSELECT\b", sql, re.I)) != 1 or re.search(r"\bJOIN\b|\bUNION\b|\bHAVING\b", sql, re.I):
        return None
    m = re.search(rf"\bWHERE\s+(?:\w+\.)?{re.escape(column)}\s*=\s*'((?:[^']|'')*)'\s*(?:ORDER\s+BY.*|LIMIT.*)?;?\s*$", sql, re.I | re.S)
    return m[1].replace("''", "'") if m else None


#: What the answer of each step must hold: keys that must be there, keys of which one must be filled, and keys of texts (fixed values; the steps are named here).
STEPS = {
    "entity_extraction": (("question",), (), ("question", "error", "raw_content")),
    "question_to_sql": ((), ("sql_query", "error"), ("result_entity", "sql_query", "justification", "answer", "error", "raw_content")),
    "complex_question": ((), ("question", "error"), ("question", "justification", "answer", "error", "raw_content")),
}


def json_fault(payload, step: str) -> str | None:
    """What is wrong with a step's parsed answer; None if nothing, if the step is unknown, or if the answer is a filled error."""
    if step not in STEPS:
        return None
    if not isinstance(payload, dict):
        return f"{step}: no object"
    if isinstance(payload.get("error"), str) and payload["error"].strip():
        return None
    needed, one_of, texts = STEPS[step]
    for k in needed:
        if not isinstance(payload.get(k), str):
            return f"{step}: {k} is missing or no text"
    if one_of and not any(payload.get(k) not in (None, "") for k in one_of):
        return f"{step}: none of {', '.join(one_of)} is filled"
    wrong = [k for k in texts if payload.get(k) is not None and not isinstance(payload[k], str)]
    return f"{step}: {wrong[0]} is no text" if wrong else None


def answers_entity(columns: list[str], entity_id: str, sql: str = "") -> bool:
    """Whether a result's columns hold the id of the entity asked for; unions and mixed content are let through."""
    names = {c.upper() for c in columns}
    if "CONTENT_TYPE" in names or re.search(r"\bUNION\b", sql, re.I):
        return True
    return entity_id.upper() in names


#: What a result is, and what follows from it: empty answers are said plainly, the other retries are the caller's.
NOTHING = {"en": "No matching results were found for this question.", "fr": "Aucun résultat ne correspond à cette question."}


def result_status(df: DataFrame | None, page: int = 1, unresolved_names: bool = False, error: str | None = None) -> str:
    """``error``, ``unresolved``, ``empty``, ``past_end``, ``scalar_zero`` or ``rows``; reads two rows at most."""
    if error or df is None:
        return "error"
    got = df.limit(2).collect()
    if not got:
        return "past_end" if page > 1 else "unresolved" if unresolved_names else "empty"
    if page == 1 and len(got) == 1 and len(df.columns) == 1 and got[0][0] == 0 and not isinstance(got[0][0], bool):
        return "scalar_zero"
    return "rows"


def ambiguous_names(df: DataFrame, name: str, id_col: str, order: list, external: str | None = None) -> DataFrame:
    """Names that several ids bear: (name, n, ids in order). Rows that share a filled external id count once, as the first of them."""
    if external is not None:
        same = F.trim(F.coalesce(F.col(external).cast("string"), F.lit("")))
        alone = df.where(same == "")
        df = alone.unionByName(first_by(df.where(same != ""), [name, external], [*order, F.col(id_col)]))
    ids = F.transform(F.array_sort(F.collect_set(F.struct(*[o for o in order], F.col(id_col).alias("_id")))), lambda s: s["_id"])
    return df.groupBy(name).agg(F.countDistinct(id_col).alias("n"), ids.alias("ids")).where("n > 1")


def credit_names(credits: DataFrame, people: DataFrame, id_col: str, person: str, name: str, where: str, order: str, most: int = 3) -> DataFrame:
    """(id, names): the first ``most`` distinct people of each id by their least billing, none last."""
    per = credits.where(where).groupBy(id_col, person).agg(F.min(order).alias("_o")).join(people.select(person, name), person)
    few = top_n(per, [id_col], [F.col("_o").asc_nulls_last(), F.col(person)], most, "_rn")
    return few.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", name))), lambda s: s[name]).alias("names"))


def hydrated(candidates: DataFrame, id_col: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Candidates with what tells them apart: each part is (id, names); ids without it get an empty list."""
    out = candidates
    for name, part in parts.items():
        out = out.join(part.select(F.col(id_col), F.col("names").alias(name)), id_col, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


@dataclass
class Intent:
    """What a question asks for, before names are resolved."""

    entity: str
    year_from: int | None = None
    year_to: int | None = None
    sort: str = "rating"
    limit: int | None = None
    count: bool = False
    credit: str | None = None
    names: list[str] = field(default_factory=list)


class QuestionCompiler(Protocol):
    def compile(self, question: str) -> Intent: ...


class RuleCompiler:
    """A deterministic compiler: decades and years, by/with, counts, top-n, trending and best."""

    trending = re.compile(r"\b(trending|popular|tendance|populaires?|buzz)\b", re.I)

    def compile(self, question: str) -> Intent:
        q = question.strip()
        low = q.lower()
        entity = "serie" if re.search(r"\b(series|shows?|s[ée]ries?)\b", low) else "person" if re.search(r"\b(actors?|actress(es)?|directors?|people|persons?)\b", low) else "movie"
        out = Intent(entity)
        if m := re.search(r"\b(?:the\s+)?(?:(\d{2})(\d)0s|(\d)0s)\b", low):
            decade = int(m[1] + m[2] + "0") if m[1] else (2000 if int(m[3]) < 3 else 1900) + int(m[3]) * 10
            out.year_from, out.year_to = decade, decade + 9
        elif m := re.search(r"\bbetween (\d{4}) and (\d{4})\b", low):
            out.year_from, out.year_to = int(m[1]), int(m[2])
        elif m := re.search(r"\bsince (\d{4})\b", low):
            out.year_from = int(m[1])
        elif m := re.search(r"\bafter (\d{4})\b", low):
            out.year_from = int(m[1]) + 1
        elif m := re.search(r"\bbefore (\d{4})\b", low):
            out.year_to = int(m[1]) - 1
        elif m := re.search(r"\((\d{4})\)", low):
            out.year_from, out.year_to = int(m[1]) - 1, int(m[1]) + 1
        elif m := re.search(r"\bin (\d{4})\b", low):
            out.year_from = out.year_to = int(m[1])
        if m := re.search(r"\b(?:top|best)\s+(\d+)\b", low):
            out.limit = int(m[1])
        out.count = bool(re.match(r"(how many|combien)\b", low))
        out.sort = "popularity" if self.trending.search(low) else "rating"
        if m := re.search(r"\b(by|with|starring)\s+((?:[A-Z][\w'.-]*\s?)+(?:(?:and|,)\s+(?:[A-Z][\w'.-]*\s?)+)*)", q):
            out.credit = "crew" if m[1] == "by" else "cast"
            out.names = [n.strip() for n in re.split(r"\s+and\s+|,\s*", m[2]) if n.strip()]
        return out


@dataclass(frozen=True)
class Fields:
    """Which columns of an entity an intent's parts stand for; ``credits`` says over which bridge a credit goes and what name it compares."""

    year: str
    rating: str
    popularity: str
    credits: dict[str, tuple[str, str]] = field(default_factory=dict)


def plan(engine, fields: dict[str, Fields], intent: Intent) -> DataFrame:
    """The rows an intent asks for: strict years, all names over their credit's bridge, count or sorted rows up to the limit.

    Names are compared without case and accents. The result of a count is one
    row ``n``; other results are sorted by popularity or rating, ties by id.
    """
    e, f = engine.catalog.entities[intent.entity], fields[intent.entity]
    df = engine.rows(e)
    if intent.year_from is not None:
        df = df.where(F.col(f.year) >= intent.year_from)
    if intent.year_to is not None:
        df = df.where(F.col(f.year) <= intent.year_to)
    for name in intent.names:  # each must match: one semi join a name
        bridge, column = f.credits[intent.credit]
        b = engine.catalog.bridges[bridge]
        mine, theirs, other = (b.left_key, b.right_key, b.right) if b.left == intent.entity else (b.right_key, b.left_key, b.left)
        o = engine.catalog.entities[other]
        ids = engine.rows(o).where(F.collate(F.col(column), "UNICODE_CI_AI_RTRIM") == name).select(F.col(o.id).alias(theirs))
        edges = engine.read(b.table)
        edges = edges.where(b.where) if b.where else edges
        df = df.join(edges.join(ids, theirs, "left_semi").select(F.col(mine).alias(e.id)), e.id, "left_semi")
    if intent.count:
        return df.agg(F.countDistinct(e.id).alias("n"))
    sort = F.col(f.popularity if intent.sort == "popularity" else f.rating).desc_nulls_last()
    out = df.orderBy(sort, F.col(e.id)).select(*e.columns)
    return out if intent.limit is None else out.limit(intent.limit)
