"""Ordered rewrites over a text column, with or without an audit of every correction.

The order of the steps is part of the result:
wording rules -> space clean-up -> dates -> double quotes -> single quotes -> dashes
-> diacritics.  Everything is one narrow projection per document: no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from functools import partial, reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    WORD_CHAR,
    as_col,
    contains_any,
    count_literal,
    is_word_char,
    let,
    macron_count,
    word_trie,
)
from .rules import DIACRITIC_LABEL, EXTENDED_DIACRITIC_MAP, FunctionRule, Rule, RuleBook

CORRECTIONS = "array<struct<from:string,to:string,rule:string,count:int>>"


def _correction(source: Column, target: Column, rule: Column, count: Column) -> Column:
    return F.struct(
        source.alias("from"), target.alias("to"), rule.alias("rule"), count.cast("int").alias("count")
    )


def _no_corrections() -> Column:
    return F.array().cast(CORRECTIONS)


# --- single steps ------------------------------------------------------------------


def tidy_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, " {2,}", " "), "(?m)^ +", "")


def curl_double_quotes(text: Column) -> Column:
    """Straight double quotes alternate open/close over the whole text."""
    paired = F.regexp_replace(text, '"([^"]*)"', "“$1”")
    return F.replace(paired, F.lit('"'), F.lit("“"))


def curl_single_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "'([^']{2,})'", "‘$1’")


def space_dashes(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("—"), F.lit(" – ")), " {2,}– {2,}", " – ")


def strip_diacritics(text: Column | str, mapping: Sequence[tuple[str, str]]) -> Column:
    """One ``translate`` for all 1:1 characters, ``replace`` for the longer results."""
    out = as_col(text)
    single = [(a, b) for a, b in mapping if len(b) == 1]
    if single:
        out = F.translate(out, "".join(a for a, _ in single), "".join(b for _, b in single))
    for a, b in mapping:
        if len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_diacritics_extended(text: Column | str) -> Column:
    return strip_diacritics(text, EXTENDED_DIACRITIC_MAP)


def strip_verse_tags(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), "</?verse>", "")


# --- rule chains -------------------------------------------------------------------


def _any_rule(text: Column, rules: Sequence[Rule]) -> Column:
    """True wherever at least one rule would fire (it may be true elsewhere, too)."""
    tests = [F.rlike(text, F.lit(r.hint or r.pattern)) for r in rules if r.regex]
    phrases = [r.phrase for r in rules if not r.regex]
    if phrases:
        tests.insert(0, contains_any(text, phrases))
    return reduce(lambda a, b: a | b, tests)


_RULE = "array<struct<pattern:string,p1:string,r1:string,p2:string,r2:string,label:string>>"


def _rule_literals(rules: Sequence[Rule]) -> Column:
    """The rules as one constant array (one literal in the plan, folded at planning)."""
    rows = []
    for rule in rules:
        steps = rule.steps()
        (p2, r2) = steps[1] if len(steps) > 1 else (None, None)
        rows.append(
            {
                "pattern": rule.pattern,
                "p1": steps[0][0],
                "r1": steps[0][1],
                "p2": p2,
                "r2": r2,
                "label": rule.label,
            }
        )
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), _RULE)


def _rewrite(text: Column, rule: Column) -> Column:
    once = F.regexp_replace(text, rule["p1"], rule["r1"])
    return F.when(rule["p2"].isNull(), once).otherwise(
        F.regexp_replace(once, rule["p2"], rule["r2"])
    )


def _fold_rules(text: Column, rules: Sequence[Rule], start, step) -> Column:
    """Run the rules in order over ``text`` (a fold over one literal array).

    The plan stays small whatever the number of rules, and each rule sees its
    predecessors' output.  One combined pattern guards the fold: if nothing matches the
    incoming text then no rule can be the first to fire, so the fold is skipped.
    """
    if not rules:
        return start(text)
    return let(
        text,
        lambda t: F.when(
            _any_rule(t, rules),
            F.aggregate(_rule_literals(rules), start(t), step),
        ).otherwise(start(t)),
    )


def _apply_in_order(text: Column, rules: Sequence[Rule]) -> Column:
    """Rewrites only, one rule after another."""

    def step(acc: Column, rule: Column) -> Column:
        return F.when(F.rlike(acc, rule["pattern"]), _rewrite(acc, rule)).otherwise(acc)

    return _fold_rules(text, rules, lambda t: t, step)


def _audit_in_order(text: Column, rules: Sequence[Rule]) -> Column:
    """``struct<text, corrections>``: every rule counts its hits on the text it sees."""

    def start(t: Column) -> Column:
        return F.struct(t.alias("text"), _no_corrections().alias("corrections"))

    def step(acc: Column, rule: Column) -> Column:
        before = acc["text"]

        def logged(sample: Column) -> Column:
            entry = _correction(
                sample,
                _rewrite(sample, rule),
                rule["label"],
                F.regexp_count(before, rule["pattern"]),
            )
            return F.struct(
                _rewrite(before, rule).alias("text"),
                F.concat(acc["corrections"], F.array(entry)).alias("corrections"),
            )

        return F.when(
            F.rlike(before, rule["pattern"]),
            let(F.regexp_substr(before, rule["pattern"]), logged),
        ).otherwise(acc)

    return _fold_rules(text, rules, start, step)


# --- rules in layers -----------------------------------------------------------------

#: Stands around a match while its text is taken apart; a text that holds it goes the slow way.
_MARK = "\ue000"
_FOUND = "array<struct<rule:int,from:string>>"
#: Most passes of a rule book in layers.
MOST_LAYERS = 4


def _words(*texts: str | None) -> list[str]:
    return [w.lower() for t in texts if t for w in re.findall(f"{WORD_CHAR}+", t)]


def _overlap(a: list[str], b: list[str]) -> bool:
    """Whether a text can hold both word sequences with words in common."""
    for one, other in ((a, b), (b, a)):
        if any(one[i : i + len(other)] == other[: len(one) - i] for i in range(len(one))):
            return True
    return False


def _layered(rule: Rule) -> bool:
    """Whether a rule is a phrase that begins and ends with a word character."""
    return not rule.regex and is_word_char(rule.phrase[0]) and is_word_char(rule.phrase[-1])


def _interact(a: Rule, b: Rule) -> bool:
    """Whether one rule's match or result may touch, make or undo a match of the other.

    Matches are whole words, so two can only overlap, or a result can only be part of a
    match, if words of theirs coincide. A result without a word can bring its neighbours together,
    which are no word characters: that only matters to phrases that hold several such
    characters in a row, or, if it is not empty, to any phrase of several words.
    """
    if _overlap(_words(a.phrase), _words(b.phrase)):
        return True
    for one, other in ((a, b), (b, a)):
        results = [r for r in (one.replacement, one.upper) if r is not None]
        if set(_words(*results)) & set(_words(other.phrase)):
            return True
        gaps = re.findall(f"(?:(?!{WORD_CHAR}).)+", other.phrase, re.S)
        if any(not _words(r) and (any(len(g) > 1 for g in gaps) or r and gaps) for r in results):
            return True
    return False


def rule_layers(rules: Sequence[Rule]) -> list[list[int]]:
    """Numbers of the rules, in layers of rules that do not interact: a rule comes in a
    later layer than every earlier rule it interacts with, so that running the layers one
    after another, and all rules of a layer at once, equals running the rules in order."""
    layer_of: list[int] = []
    for j, rule in enumerate(rules):
        before = [layer_of[i] for i in range(j) if _interact(rules[i], rule)]
        layer_of.append(max(before, default=-1) + 1)
    return [[j for j, at in enumerate(layer_of) if at == n] for n in range(max(layer_of, default=-1) + 1)]


def _segments(rules: Sequence[Rule]) -> list[tuple[bool, list[int]]]:
    """Consecutive rules that can be layered, and those between them."""
    out: list[tuple[bool, list[int]]] = []
    for i, rule in enumerate(rules):
        if not out or out[-1][0] != _layered(rule):
            out.append((_layered(rule), []))
        out[-1][1].append(i)
    return out


def _in_layers(rules: Sequence[Rule]) -> bool:
    """Whether the rules run in layers; a book that needs many is run in order instead,
    since every layer nests the expression once more."""
    parts = [(plain, [rules[i] for i in numbers]) for plain, numbers in _segments(rules)]
    passes = sum(len(rule_layers(some)) if plain else 1 for plain, some in parts)
    return any(plain for plain, _ in parts) and passes <= MOST_LAYERS


def _taken_apart(text: Column, rules: Sequence[Rule]) -> Column:
    """The text as an array: what lies between matches at even, matches at odd places.

    Matches are sought in any case; one of another case than its rule asks for has no rule.
    """
    # the character before a match is matched, not looked back at, hence the blank in front
    pattern = f"(?i)(\\W)({word_trie([r.phrase for r in rules])})"
    marked = F.regexp_replace(F.concat(F.lit(" "), text), pattern, f"$1{_MARK}$2{_MARK}")
    # named once: in a lambda, a second mention would mark the text again
    return F.split(F.substr(marked, F.lit(2)), _MARK)


def _lookup(numbered: Sequence[tuple[int, Rule]]) -> Column:
    """Map from a match to its rule's number and results; exact phrases are keyed by ``=``."""
    rows = {
        r.phrase.lower() if r.ignore_case else f"={r.phrase}": {"rule": i, "lower": r.replacement, "upper": r.upper}
        for i, r in reversed(numbered)
    }
    kind = "map<string,struct<rule:int,lower:string,upper:string>>"
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), kind)


def _rule_of(match: Column, lookup: Column) -> Column:
    exact = F.try_element_at(lookup, F.concat(F.lit("="), match))
    return F.coalesce(exact, F.try_element_at(lookup, F.lower(match)))


def _result(match: Column, rule: Column) -> Column:
    """What becomes of a match; the rule is bound, since looking it up reads through the map."""

    def of(found: Column) -> Column:
        head = F.left(match, F.lit(1))
        result = F.when(found["upper"].isNotNull() & (head == F.upper(head)), found["upper"])
        return result.when(found.isNotNull(), found["lower"]).otherwise(match)

    return let(rule, of)


def _joined(pieces: Column, lookup: Column) -> Column:
    def rewritten(piece: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, _result(piece, _rule_of(piece, lookup))).otherwise(piece)

    return F.array_join(F.transform(pieces, rewritten), "")


def _apply_layer(text: Column, numbered: Sequence[tuple[int, Rule]]) -> Column:
    lookup = _lookup(numbered)

    def rewritten(t: Column) -> Column:
        pieces = _taken_apart(t, [r for _, r in numbered])
        return let(pieces, lambda p: F.when(F.size(p) > 1, _joined(p, lookup)).otherwise(t))

    return let(text, rewritten)


def _apply_layers(text: Column, rules: Sequence[Rule]) -> Column:
    for layer in rule_layers(rules):
        text = _apply_layer(text, [(i, rules[i]) for i in layer])
    return text


def _audit_layer(state: Column, numbered: Sequence[tuple[int, Rule]]) -> Column:
    """``struct<text, found>`` after one more layer; ``found`` are all matches so far."""
    lookup = _lookup(numbered)

    def logged(acc: Column, pieces: Column) -> Column:
        matches = F.filter(pieces, lambda _, i: i % 2 == 1)
        found = F.transform(matches, lambda m: F.struct(_rule_of(m, lookup)["rule"].alias("rule"), m.alias("from")))
        found = F.filter(found, lambda f: f["rule"].isNotNull())
        both = F.concat(acc["found"], found).alias("found")
        return F.when(F.size(pieces) > 1, F.struct(_joined(pieces, lookup).alias("text"), both)).otherwise(acc)

    def run(acc: Column) -> Column:
        return let(_taken_apart(acc["text"], [r for _, r in numbered]), lambda pieces: logged(acc, pieces))

    return let(state, run)


def _audit_layers(text: Column, rules: Sequence[Rule]) -> Column:
    """As :func:`_audit_in_order`: matches of all layers, then one row per rule in order."""
    state = F.struct(text.alias("text"), F.array().cast(_FOUND).alias("found"))
    for layer in rule_layers(rules):
        state = _audit_layer(state, [(i, rules[i]) for i in layer])
    labels = F.from_json(F.lit(json.dumps([r.label for r in rules], ensure_ascii=False)), "array<string>")
    everything = _lookup(list(enumerate(rules)))

    def row(rule: Column, own: Column) -> Column:
        first = F.get(own, F.lit(0))["from"]
        return _correction(first, _result(first, _rule_of(first, everything)), F.get(labels, rule), F.size(own))

    def rows(acc: Column) -> Column:
        numbers = F.array_sort(F.array_distinct(F.transform(acc["found"], lambda f: f["rule"])))
        corrections = F.transform(
            numbers, lambda n: let(F.filter(acc["found"], lambda f: f["rule"] == n), lambda own: row(n, own))
        )
        none = F.size(acc["found"]) == 0
        return F.struct(
            acc["text"].alias("text"), F.when(none, _no_corrections()).otherwise(corrections).alias("corrections")
        )

    return let(state, rows)


def apply_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """Rewrites only.

    Phrases run in layers: one pattern finds the matches of a whole layer, and their
    results are looked up and put back between the other pieces. So a text that any rule
    hits costs one pass per layer, however many do. Regular expressions, and phrases that begin or
    end with other characters, run one after another at their place in the list; so does a
    whole book that would need more than ``MOST_LAYERS`` passes.
    """
    if not rules:
        return text

    def layered(t: Column) -> Column:
        for plain, numbers in _segments(rules):
            some = [rules[i] for i in numbers]
            t = _apply_layers(t, some) if plain else _apply_in_order(t, some)
        return t

    if not _in_layers(rules):
        return _apply_in_order(text, rules)
    return let(
        text,
        lambda t: F.when(F.contains(t, F.lit(_MARK)), _apply_in_order(t, rules))
        .when(_any_rule(t, rules), layered(t))
        .otherwise(t),
    )


def audit_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """``struct<text, corrections>``: every rule counts its hits on the text it sees; runs
    as :func:`apply_rules` does."""
    if not _in_layers(rules):
        return _audit_in_order(text, rules)

    def layered(t: Column) -> Column:
        parts = _segments(rules)
        plain, numbers = parts[0]
        out = (_audit_layers if plain else _audit_in_order)(t, [rules[i] for i in numbers])
        for plain, numbers in parts[1:]:
            out = _then(out, partial(_audit_layers if plain else _audit_in_order, rules=[rules[i] for i in numbers]))
        return out

    return let(
        text,
        lambda t: F.when(F.contains(t, F.lit(_MARK)), _audit_in_order(t, rules))
        .when(_any_rule(t, rules), layered(t))
        .otherwise(F.struct(t.alias("text"), _no_corrections().alias("corrections"))),
    )


def custom_rewrite(
    text: Column | str, pattern: str, replace: Callable[[re.Match], str]
) -> Column:
    """A rule whose replacement is a Python function of the match (Arrow batches).

    The escape hatch for what a pattern and a replacement text cannot say; everything
    else should be a :class:`Rule`, which stays in the JVM.
    """
    found = re.compile(pattern)

    @F.pandas_udf("string")
    def rewrite(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: t if t is None else found.sub(replace, t))

    return rewrite(as_col(text))


# --- function rules among the others ---------------------------------------------------


#: Rows of an Arrow batch that are Python objects at the same time.
FUNCTION_ROWS = 128


def _parts(rules: Sequence[Rule | FunctionRule]) -> list[tuple[bool, list]]:
    """Consecutive rules of one kind; the flag tells functions."""
    return [(kind, list(some)) for kind, some in groupby(rules, lambda r: isinstance(r, FunctionRule))]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``FUNCTION_ROWS`` rows, which share their memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, FUNCTION_ROWS):
            yield batch.slice(at, FUNCTION_ROWS)


def _run_functions(df: DataFrame, audit: str, rules: Sequence[FunctionRule]) -> DataFrame:
    """``df`` with the ``struct<text, corrections>`` column ``audit`` after function rules;
    rows pass through one Arrow step, whose other columns stay as they are."""
    found = [(re.compile(r.pattern), r.replace, r.label) for r in rules]

    def one(held: dict) -> dict:
        text, log = held["text"], list(held["corrections"])
        for pattern, result, label in found if text is not None else ():
            first = pattern.search(text)
            if first is not None:
                text, count = pattern.subn(lambda m, f=result: f(m.group()), text)
                log.append({"from": first.group(), "to": result(first.group()), "rule": label, "count": count})
        return {"text": text, "corrections": log}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at = batch.schema.get_field_index(audit)
            done = pa.array([one(h) for h in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), done)

    return df.mapInArrow(run, df.schema)


def _has_functions(rules: Sequence[Rule | FunctionRule]) -> bool:
    return any(isinstance(r, FunctionRule) for r in rules)


def apply_mixed(df: DataFrame, text_col: str, rules: Sequence[Rule | FunctionRule]) -> DataFrame:
    """Rewrites only, rules of the JVM and functions in the order given."""
    if not _has_functions(rules):
        return df.withColumn(text_col, apply_rules(F.col(text_col), rules))
    out = audit_mixed(df, text_col, rules, "__mixed")
    return out.withColumn(text_col, F.col("__mixed")["text"]).drop("__mixed")


def audit_mixed(df: DataFrame, text: str, rules: Sequence[Rule | FunctionRule], out: str) -> DataFrame:
    """``df`` plus ``out``, the ``struct<text, corrections>`` after all rules in order: rules
    of the JVM and functions hand it on to each other, all in one narrow stage."""
    if not _has_functions(rules):
        return df.withColumn(out, audit_rules(F.col(text), rules))
    df = df.withColumn(out, F.struct(F.col(text).alias("text"), _no_corrections().alias("corrections")))
    for functions, some in _parts(rules):
        if functions:
            df = _run_functions(df, out, some)
        else:
            df = df.withColumn(out, _then(F.col(out), partial(audit_rules, rules=some)))
    return df


# --- whole enforcement -------------------------------------------------------------


def enforced_text(text: Column | str, book: RuleBook | None = None, profile: str = "full") -> Column:
    """The rewritten text as one expression.

    ``profile``: ``full`` (all steps), ``light`` (quotes, dashes, spaces only) or
    ``extended`` (full, then the two-case diacritic table).
    """
    c = as_col(text)
    if profile == "light":
        return tidy_spaces(space_dashes(curl_single_quotes(curl_double_quotes(c))))
    book = book or RuleBook.default()
    if _has_functions(book.wording):
        raise ValueError("a book with functions takes several projections: use enforce")
    c = tidy_spaces(apply_rules(c, book.wording))
    c = apply_rules(c, book.dates)
    c = space_dashes(curl_single_quotes(curl_double_quotes(c)))
    c = strip_diacritics(c, book.diacritics)
    return strip_diacritics_extended(c) if profile == "extended" else c


def enforce(
    df: DataFrame,
    book: RuleBook | None = None,
    profile: str = "full",
    audit: bool = False,
    text_col: str = "text",
) -> DataFrame:
    """Rewrite ``text_col``; with ``audit`` also add ``corrections`` and ``total_fixes``."""
    if not audit:
        if book is not None and profile != "light" and _has_functions(book.wording):
            df, book = apply_mixed(df, text_col, book.wording), replace(book, wording=())
        return df.withColumn(text_col, enforced_text(text_col, book, profile))
    if profile == "light":  # the light profile does not log
        out = df.withColumn(text_col, enforced_text(text_col, book, profile))
        return out.withColumn("corrections", _no_corrections()).withColumn("total_fixes", F.lit(0))
    book = book or RuleBook.default()
    tmp = "__audit"
    out = audit_mixed(df, text_col, book.wording, tmp)
    out = out.withColumn(tmp, _then(F.col(tmp), lambda t: audit_rules(tidy_spaces(t), book.dates)))
    out = out.withColumn(tmp, _then(F.col(tmp), lambda t: _audit_marks(t, book.diacritics)))
    text = F.col(tmp)["text"]
    if profile == "extended":
        text = strip_diacritics_extended(text)
    out = out.withColumn(text_col, text).withColumn("corrections", F.col(tmp)["corrections"])
    return out.drop(tmp).withColumn("total_fixes", total_fixes("corrections"))


def _then(previous: Column, following) -> Column:
    def both(prev: Column) -> Column:
        return let(
            following(prev["text"]),
            lambda nxt: F.struct(
                nxt["text"].alias("text"),
                F.concat(prev["corrections"], nxt["corrections"]).alias("corrections"),
            ),
        )

    return let(previous, both)


def _audit_marks(text: Column, mapping: Sequence[tuple[str, str]]) -> Column:
    """Quotes, dashes and diacritics with their fixed log rows."""

    def quotes(t: Column) -> Column:
        return let(curl_double_quotes(t), lambda a: singles(t, a))

    def singles(t: Column, a: Column) -> Column:
        return let(curl_single_quotes(a), lambda b: dashes(t, a, b))

    def dashes(t: Column, a: Column, b: Column) -> Column:
        return let(space_dashes(b), lambda c: marks(t, a, b, c))

    def marks(t: Column, a: Column, b: Column, c: Column) -> Column:
        rows = [
            F.when(
                a != t,
                _correction(
                    F.lit('"'),
                    F.lit("“/”"),
                    F.lit("straight quotes→curly quotes"),
                    count_literal(t, '"'),
                ),
            ),
            F.when(
                b != a,
                _correction(
                    F.lit("'x'"), F.lit("‘x’"), F.lit("straight single quotes→curly"), F.lit(1)
                ),
            ),
            F.when(
                c != b,
                _correction(
                    F.lit("—"), F.lit(" – "), F.lit("em dash→spaced en dash"), count_literal(b, "—")
                ),
            ),
        ]
        pairs = F.from_json(
            F.lit(json.dumps([{"f": a, "t": b} for a, b in mapping], ensure_ascii=False)),
            "array<struct<f:string,t:string>>",
        )
        letters = F.transform(
            pairs,
            lambda m: _correction(
                m["f"],
                m["t"],
                F.lit(DIACRITIC_LABEL),
                F.length(c) - F.length(F.replace(c, m["f"], F.lit(""))),
            ),
        )
        return F.struct(
            strip_diacritics(c, mapping).alias("text"),
            F.concat(
                F.filter(F.array(*rows), lambda r: r.isNotNull()),
                F.filter(letters, lambda r: r["count"] > 0),
            ).alias("corrections"),
        )

    return let(text, quotes)


def total_fixes(corrections: Column | str) -> Column:
    return F.aggregate(as_col(corrections), F.lit(0), lambda acc, c: acc + c["count"])


def preserve_macrons(
    df: DataFrame,
    before_col: str,
    after_col: str,
    text_col: str = "text",
    restored_col: str = "restored",
) -> DataFrame:
    """Put back verse lines whose macrons a later stage dropped.

    Each macron line of ``before`` that is missing from ``after`` replaces the first
    occurrence of its macron-less twin; the macrons put back are counted.
    """
    before, after = F.col(before_col), F.col(after_col)
    n_before = macron_count(before)
    lines = F.filter(F.split(before, "\n"), lambda s: F.rlike(s, F.lit("[Āā]")))
    start = F.struct(after.alias("text"), F.lit(0).alias("restored"))

    def step(acc: Column, line: Column) -> Column:
        text = acc["text"]

        def patch(at: Column) -> Column:
            patched = F.concat(
                F.substring(text, F.lit(1), at - 1),
                line,
                F.substring(text, at + F.length(line), F.length(text)),
            )
            return F.when(
                (at > 0) & ~F.contains(text, line),
                F.struct(
                    patched.alias("text"),
                    (acc["restored"] + macron_count(line)).alias("restored"),
                ),
            ).otherwise(acc)

        return let(F.instr(text, F.translate(line, "Āā", "Aa")), patch)

    fixed = F.when((n_before == 0) | (macron_count(after) >= n_before), start).otherwise(
        F.aggregate(lines, start, step)
    )
    out = df.withColumn("__macrons", fixed)
    return (
        out.withColumn(text_col, F.col("__macrons")["text"])
        .withColumn(restored_col, F.col("__macrons")["restored"])
        .drop("__macrons")
    )
