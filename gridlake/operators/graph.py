"""A graph of triples (s, p, o, o_type, datatype) with pattern queries, and its text forms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SCHEMA = "s string, p string, o string, o_type string, datatype string"


def expand(c: Column, namespaces: dict[str, str]) -> Column:
    """Prefixed names to full ones; others stay."""
    return reduce(lambda x, kv: F.when(c.startswith(kv[0] + ":"), F.concat(F.lit(kv[1]), F.substr(c, F.lit(len(kv[0]) + 2)))).otherwise(x), namespaces.items(), c)


def uri_identifier(c: Column) -> Column:
    """A name without scheme, hash signs and dots."""
    return F.regexp_replace(c, r"https?://|#|\.", "")


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Solutions of a basic graph pattern; terms beginning with ? are variables and become columns.

    Each pattern is a filtered projection of the triples; patterns join on their shared variables in
    the order given, so begin with the most selective. Patterns without a common variable are refused.
    """
    out: DataFrame | None = None
    for s, p, o in patterns:
        part, names = triples, {}
        for column, term in (("s", s), ("p", p), ("o", o)):
            if not term.startswith("?"):
                part = part.where(F.col(column) == term)
            elif term[1:] in names:
                part = part.where(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        part = part.select(*[F.col(c).alias(n) for n, c in names.items()])
        if out is None:
            out = part
        else:
            shared = [n for n in names if n in out.columns]
            if not shared:
                raise ValueError("a pattern shares no variable with those before it")
            out = out.join(part, shared)
    if out is None:
        raise ValueError("no pattern")
    return out


def optional(solutions: DataFrame, triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """The solutions, with the variables of the patterns where these match, else NULL."""
    more = match(triples, patterns)
    return solutions.join(more, [c for c in more.columns if c in solutions.columns], "left")


def union(*solutions: DataFrame) -> DataFrame:
    """All solutions; variables that one side lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), solutions)


def latest(solutions: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Per key the solution with the greatest ``by``; ties by the other columns."""
    rest = [c for c in solutions.columns if c not in keys]
    pick = F.max(F.struct(F.col(by), *[F.col(c) for c in rest if c != by])).alias("_m")
    return solutions.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def add_item(triples: DataFrame, items: DataFrame, subject: str, classes: list[str], data: dict[str, str], links: dict[str, str]) -> DataFrame:
    """Append, for each row of items, its classes, literals (property -> column) and links (property -> column)."""
    s = F.col(subject)
    t = lambda p, o, kind, datatype: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_type"), F.lit(datatype).cast("string").alias("datatype"))
    names = {"timestamp": "dateTime", "timestamp_ntz": "dateTime", "double": "double", "float": "double", "int": "integer", "bigint": "integer", "boolean": "boolean"}
    cells = [t(TYPE, F.lit(c), "uri", None) for c in classes]
    for p, c in data.items():
        kind = items.schema[c].dataType.simpleString()
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind.startswith("timestamp") else F.col(c).cast("string")
        cells.append(t(p, text, "literal", names.get(kind)))
    cells += [t(p, F.col(c).cast("string"), "uri", None) for p, c in links.items()]
    return triples.unionByName(items.select(F.inline(F.array(*cells))).where("o IS NOT NULL"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files; comments and lines that are no triple are passed over."""
    line = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@[A-Za-z\-]+)?)\s*\.\s*(?:#.*)?$'
    g = lambda k: F.regexp_extract("value", line, k)
    literal = F.col("value").rlike(r'^[^"]*"')
    plain = F.replace(F.replace(F.replace(F.replace(g(6), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\\\"), F.lit("\\"))
    return spark.read.text(path).where(F.col("value").rlike(line)).select(
        F.concat(g(1), g(2)).alias("s"), g(3).alias("p"), F.when(literal, plain).otherwise(F.concat(g(4), g(5))).alias("o"),
        F.when(literal, "literal").otherwise("uri").alias("o_type"), F.when(g(7) != "", g(7)).alias("datatype"),
    )


def _escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")


def _term(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def _object() -> Column:
    datatype = F.when(F.col("datatype").contains("://"), F.col("datatype")).otherwise(F.concat(F.lit("http://www.w3.org/2001/XMLSchema#"), "datatype"))
    text = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), datatype, F.lit(">")), F.lit("")))
    return F.when(F.col("o_type") == "literal", text).otherwise(_term(F.col("o")))


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): one line of N-Triples per triple."""
    return triples.select(F.concat_ws(" ", _term(F.col("s")), _term(F.col("p")), _object(), F.lit(".")).alias("value"))


def turtle(triples: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """(value): one Turtle statement per subject. Write the prefixes of turtle_head() first."""
    short = lambda c: reduce(lambda x, kv: F.when(c.rlike("^" + re.escape(kv[1]) + r"[A-Za-z0-9_\-]+$"), F.concat(F.lit(kv[0] + ":"), F.substr(c, F.lit(len(kv[1]) + 1)))).otherwise(x), namespaces.items(), _term(c))
    pred = F.when(F.col("p") == TYPE, F.lit("a")).otherwise(short(F.col("p")))
    obj = F.when(F.col("o_type") == "literal", _object()).otherwise(short(F.col("o")))
    return triples.select("s", F.concat_ws(" ", pred, obj).alias("x")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("x")), " ;\n    ").alias("x")).select(F.concat(short(F.col("s")), F.lit(" "), F.col("x"), F.lit(" .")).alias("value"))


def turtle_head(namespaces: dict[str, str]) -> str:
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in namespaces.items())


def write_turtle(statements: DataFrame, namespaces: dict[str, str], path: str) -> None:
    """Write turtle() as text files, each of which begins with the prefixes and so can be read alone."""
    head = turtle_head(namespaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if b.num_rows:
                values = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([head + values[0], *values[1:]] if first else values)], ["value"])
                first = False

    statements.mapInArrow(run, "value string").write.text(path)


_TURTLE = re.compile(
    r"""\s+|\#[^\n]*|(?P<uri><[^>]*>)|(?P<text>\"\"\".*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|\^\^(?P<kind><[^>]*>|[\w\-]*:[\w\-.]*\w)|@(?P<at>prefix|base)\b|@(?P<lang>[A-Za-z\-]+)"""
    r"""|(?P<number>[+\-]?\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?)|(?P<name>_?[\w\-]*:(?:[\w\-.]*[\w\-])?)|(?P<word>a|true|false|PREFIX|BASE)\b|(?P<mark>[;,.])""",
    re.S,
)
_XSD = "http://www.w3.org/2001/XMLSchema#"
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "'": "'", "\\": "\\"}


def parse_turtle(text: str) -> Iterator[tuple]:
    """Triples of a Turtle document: prefixes, base, a, lists by ; and , and plain, typed and tagged literals. Collections and [ ] are errors."""
    names, base = {}, ""
    at, terms, literal = 0, [], None

    def full(term: str) -> str:
        if term[0] == "<":
            return term[1:-1] if "://" in term or ":" in term else base + term[1:-1]
        if term.startswith("_:"):
            return term
        prefix, _, rest = term.partition(":")
        return names[prefix] + rest

    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"not understood: {text[at : at + 40]!r}")
        at, kind, word = m.end(), m.lastgroup, m.group()
        if kind in ("at",) or word in ("PREFIX", "BASE"):
            head = re.compile(r"\s*(?:([\w\-]*):)?\s*<([^>]*)>\s*\.?").match(text, at)
            if word.lower().endswith("base"):
                base = head.group(2)
            else:
                names[head.group(1)] = head.group(2)
            at = head.end()
        elif kind == "kind" and literal is not None:
            terms[-1] = (terms[-1][0], "literal", full(m.group("kind")))
        elif kind in ("uri", "name"):
            terms.append((full(word), "uri", None))
        elif kind == "text":
            body = word[3:-3] if word.startswith('"""') else word[1:-1]
            body = re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda e: _ESCAPES.get(e.group(3), e.group(3)) if e.group(3) else chr(int(e.group(1) or e.group(2), 16)), body, flags=re.S)
            terms.append((body, "literal", None))
        elif kind == "number":
            terms.append((word, "literal", _XSD + ("integer" if re.fullmatch(r"[+\-]?\d+", word) else "double" if "e" in word.lower() else "decimal")))
        elif kind == "word":
            terms.append((TYPE, "uri", None) if word == "a" else (word, "literal", _XSD + "boolean"))
        elif kind == "mark":
            if len(terms) == 3:
                (s, _, _), (p, _, _), (o, o_kind, datatype) = terms
                yield s, p, o, o_kind, datatype
            elif terms and not (word in ";." and len(terms) == 1):
                raise ValueError(f"{len(terms)} terms before {word!r}")
            terms = terms[: {",": 2, ";": 1, ".": 0}[word]]
        literal = terms[-1] if terms and terms[-1][1] == "literal" else None


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files. A file is read by one task, since its prefixes hold to its end: write many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for text in pdf["value"]:
                yield pd.DataFrame(parse_turtle(text), columns=["s", "p", "o", "o_type", "datatype"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, SCHEMA)


def hierarchy_paths(c: Column, sep: str = ".") -> Column:
    """All prefixes of a dotted name: a, a.b, a.b.c."""
    parts = F.split(c, re.escape(sep))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), sep))


def dummy_matrix(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """(key, value...): how often each of the values occurs per key."""
    return df.groupBy(key).agg(*[F.sum(F.coalesce((F.col(column) == v).cast("int"), F.lit(0))).alias(v) for v in values])
