"""Newick text in and out of edge tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.labels import quoted
from cladeframe.session import ship_package

MARKS = frozenset("(),:;")


def tokens(text: str) -> list[str]:
    """Marks, quoted labels (with their quotes) and bare words of a Newick text; comments and white space go."""
    out, at = [], 0
    while at < len(text):
        start, c = at, text[at]
        if c.isspace():
            at += 1
        elif c == "[":
            at = text.find("]", at) + 1
            if not at:
                raise ValueError("Newick comment without end")
        elif c in MARKS:
            out.append(c)
            at += 1
        elif c == "'":
            # A doubled quote stands for one; an odd number of quotes ends the label.
            while True:
                at = text.find("'", at + 1)
                if at < 0:
                    raise ValueError("Newick label without closing quote")
                if text[at + 1:at + 2] != "'":
                    break
                at += 1
            at += 1
            out.append(text[start:at])
        elif c == "]":
            raise ValueError("Newick comment without start")
        else:
            while at < len(text) and text[at] not in MARKS and text[at] not in "[]'" and not text[at].isspace():
                at += 1
            out.append(text[start:at])
    return out


def branch_length(word: str) -> float:
    try:
        value = float(word)
    except ValueError:
        value = math.nan
    if not (math.isfinite(value) and value >= 0):
        raise ValueError(f"branch length {word!r} is no finite number of at least 0")
    return value


def parse_newick(text: str) -> list[tuple[int, int, str | None, float | None]]:
    """(node, parent, name, length) per edge; a root with two children is suppressed.

    Names belong to leaves; comments and inner labels are dropped.
    """
    nodes: list[list] = [[None, None, None]]  # parent, name, length
    children: dict[int, int] = {}
    current, done, expect_length = 0, False, False
    for token in tokens(text):
        if done:
            raise ValueError("malformed Newick text")
        if expect_length:
            nodes[current][2], expect_length = branch_length(token), False
        elif token in ("(", ","):
            parent = current if token == "(" else nodes[current][0]
            if parent is None or (token == "(" and (current in children or nodes[current][1])):
                raise ValueError("malformed Newick text")
            nodes.append([parent, None, None])
            children[parent] = children.get(parent, 0) + 1
            current = len(nodes) - 1
        elif token == ")":
            current = nodes[current][0]
            if current is None:
                raise ValueError("unbalanced parentheses")
        elif token == ":":
            expect_length = True
        elif token == ";":
            done = True
        else:
            name = token[1:-1].replace("''", "'") if token[0] == "'" else token
            if current not in children:
                if nodes[current][1]:
                    raise ValueError("two names for one node")
                nodes[current][1] = name
    if not done or current != 0 or expect_length:
        raise ValueError("Newick text must hold one tree and end with ';'")
    names = [n[1] for k, n in enumerate(nodes) if k not in children]
    if None in names or len(set(names)) != len(names) or len(names) < 2:
        raise ValueError("leaves need unique names")
    tops = [k for k, n in enumerate(nodes) if n[0] == 0]
    if len(tops) == 2:
        keep, moved = tops if tops[0] in children else tops[::-1]
        lengths = [nodes[keep][2], nodes[moved][2]]
        nodes[moved][0], nodes[keep][0] = keep, None
        nodes[moved][2] = None if None in lengths else sum(lengths)
        nodes[0] = [None, None, None]
    return [(k, n[0], n[1], n[2]) for k, n in enumerate(nodes) if n[0] is not None]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """(file, tree, node, parent, name, length): one tree per line, trees spread over tasks."""
    from cladeframe.sources.alignments import numbered_lines

    ship_package(spark)

    def rows(batches):
        for batch in batches:
            for line, text in zip(batch["line"], batch["value"]):
                table = pd.DataFrame(parse_newick(text), columns=["node", "parent", "name", "length"])
                table.insert(0, "tree", line)
                yield table

    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    return lines.mapInPandas(rows, "tree long, node long, parent long, name string, length double")


def length_text(length):
    """``:`` and ten significant digits, or nothing for a null."""
    digits = F.format_string("%.9e", length).cast("double").cast("string")
    return F.when(length.isNotNull(), F.concat(F.lit(":"), F.regexp_replace(digits, r"\.0$", ""))).otherwise(F.lit(""))


def to_newick(nodes: DataFrame, names: DataFrame, lengths: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(newick): text of a tree from (node, parent, enter, leave), as :func:`cladeframe.operators.trees.rooted` gives them.

    Every node adds its marks and its text where the tour enters and leaves
    it, so the text is one ordered aggregate and a ladder costs no more than a
    balanced tree. The neighbour of the root leaf is the head of the text, with
    the root leaf first; children follow the tour. ``lengths`` is
    (node, length) and ``labels`` (node, label) for inner nodes.
    """
    rows = nodes.select("node", "parent", "enter", "leave").join(names.select("node", quoted(F.col("name")).alias("_name")), "node", "left")
    for extra, column, kind in ((lengths, "length", "double"), (labels, "label", "string")):
        rows = rows.join(extra.select("node", column), "node", "left") if extra is not None else rows.withColumn(column, F.lit(None).cast(kind))
    first = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.min("enter").alias("enter"), F.lit(True).alias("_first"))
    inner = nodes.select(F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
    rows = rows.join(first, ["parent", "enter"], "left").join(inner, "node", "left")
    head = F.col("enter") == 0  # the only neighbour of the root leaf
    root_length = rows.where(head).select(length_text(F.col("length")).alias("_root_length"))
    root = rows.where("parent IS NULL").select(F.col("_name").alias("_root")).crossJoin(root_length)  # one row by one row
    comma = F.when(F.col("_first").isNotNull(), "").otherwise(",")
    body = rows.where("parent IS NOT NULL").crossJoin(root)
    opening = F.when(head, F.concat(F.lit("("), "_root", "_root_length", F.lit(","))).otherwise(F.concat(comma, F.when(F.col("_inner"), "(").otherwise("")))
    closing = F.when(head, F.lit(");")).when(F.col("_inner"), F.concat(F.lit(")"), F.coalesce("label", F.lit("")), length_text(F.col("length")))) \
        .otherwise(F.concat(F.col("_name"), length_text(F.col("length"))))
    pieces = body.select(F.explode(F.array(F.struct(F.col("enter").alias("at"), opening.alias("text")), F.struct(F.col("leave").alias("at"), closing.alias("text")))).alias("p"))
    # Steps of the tour differ, so every piece has a place of its own; the text itself is the one row asked for.
    return pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("newick"))
