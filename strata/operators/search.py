"""Keyword search: a tokenized inverted index and boolean queries over it.

A query is words, AND, OR, parentheses and `field : word`. Words are runs of letters and digits of any script, lower-cased. OR is
the default between words, AND binds more tightly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import Code, StrataError

ALL = "ALL_FIELDS"
SPLIT = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SPLIT), lambda x: x != ""))


def inverted_index(docs: DataFrame, entry: str, fields: list[str]) -> DataFrame:
    """entry, field, term: each term of each field once, and once under ALL_FIELDS (which holds the entry's name too)."""
    whole = F.concat_ws(" ", F.col(entry).cast("string"), *[F.col(f).cast("string") for f in fields])
    per_field = F.array(F.struct(F.lit(ALL).alias("field"), terms(whole).alias("terms")), *[F.struct(F.lit(f).alias("field"), terms(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("terms")) for f in fields])
    rows = docs.select(F.col(entry).alias("entry"), F.explode(per_field).alias("x"))
    return rows.select("entry", "x.field", F.explode("x.terms").alias("term"))


@dataclass(frozen=True)
class Term:
    field: str
    word: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


def parse(query: str):
    tokens = re.findall(r"\(|\)|:|[^\s():]+", query)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise StrataError(Code.QUERY_SYNTAX, query)
        at += 1
        return tokens[at - 1]

    def either():
        args = [both()]
        while peek() not in (None, ")"):
            if peek() == "OR":
                take()
            args.append(both())
        return args[0] if len(args) == 1 else Op("or", tuple(args))

    def both():
        args = [one()]
        while peek() == "AND":
            take()
            args.append(one())
        return args[0] if len(args) == 1 else Op("and", tuple(args))

    def one():
        t = take()
        if t == "(":
            inner = either()
            if take() != ")":
                raise StrataError(Code.QUERY_SYNTAX, query)
            return inner
        if t in (")", ":", "AND", "OR"):
            raise StrataError(Code.QUERY_SYNTAX, query)
        field = ALL
        if peek() == ":":
            take()
            field, t = t, take()
        words = [w for w in regex.split(SPLIT, t.lower()) if w]
        if not words:
            raise StrataError(Code.QUERY_SYNTAX, query)
        return Term(field, words[0]) if len(words) == 1 else Op("and", tuple(Term(field, w) for w in words))

    tree = either()
    if peek() is not None:
        raise StrataError(Code.QUERY_SYNTAX, query)
    return tree


def leaves(tree) -> list[Term]:
    return [tree] if isinstance(tree, Term) else [t for a in tree.args for t in leaves(a)]


def search_index(index: DataFrame, query: str) -> DataFrame:
    """Entries that satisfy the query, from the inverted index: the query's postings only, one aggregation by entry."""
    tree = parse(query)
    own = list(dict.fromkeys(leaves(tree)))
    hit = lambda t: (F.col("field") == t.field) & (F.col("term") == t.word)
    any_hit = hit(own[0])
    for t in own[1:]:
        any_hit = any_hit | hit(t)
    flags = index.where(any_hit).groupBy("entry").agg(*[F.max(hit(t)).alias(f"_t{i}") for i, t in enumerate(own)])

    def test(node) -> Column:
        if isinstance(node, Term):
            return F.col(f"_t{own.index(node)}")
        out = test(node.args[0])
        for a in node.args[1:]:
            out = out & test(a) if node.kind == "and" else out | test(a)
        return out

    return flags.where(test(tree)).select("entry")


def search(docs: DataFrame, query: str, entry: str, fields: list[str]) -> DataFrame:
    """Entries that satisfy the query, by a scan of the rows: no index and no shuffle."""
    tree = parse(query)
    whole = F.concat_ws(" ", F.col(entry).cast("string"), *[F.col(f).cast("string") for f in fields])
    text = lambda f: terms(whole if f == ALL else F.coalesce(F.col(f).cast("string"), F.lit("")))

    def test(node) -> Column:
        if isinstance(node, Term):
            return F.array_contains(text(node.field), node.word) if node.field == ALL or node.field in fields else F.lit(False)
        out = test(node.args[0])
        for a in node.args[1:]:
            out = out & test(a) if node.kind == "and" else out | test(a)
        return out

    return docs.where(test(tree)).select(F.col(entry).alias("entry"))


def scored(index: DataFrame, query: str) -> DataFrame:
    """entry, score of the entries that satisfy the query, the best first: the sum over its words of how rare each is."""
    own = list(dict.fromkeys(leaves(parse(query))))
    hit = lambda t: (F.col("field") == t.field) & (F.col("term") == t.word)
    n = index.agg(F.count_distinct("entry")).first()[0]
    df = index.agg(*[F.count_if(hit(t)).alias(f"_t{i}") for i, t in enumerate(own)]).first()  # a number per word
    weight = F.lit(0.0)
    for i, t in enumerate(own):
        weight = F.when(hit(t), F.log(F.lit(1 + (n - df[i] + 0.5) / (df[i] + 0.5)))).otherwise(weight)
    found = index.withColumn("score", weight).where("score > 0").groupBy("entry").agg(F.sum("score").alias("score"))
    return found.join(search_index(index, query), "entry", "left_semi").orderBy(F.desc("score"), "entry")
