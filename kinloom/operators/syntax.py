"""A structural front end for Java-like sources: types, methods, statements and their regions as nodes.

A recovering parser over the token stream: braces, parentheses and semicolons give the structure, a few keywords the
kinds. It never fails on a text; unbalanced ends close at the end of the text, and nesting may be of any depth.
"""

from __future__ import annotations

import re
from collections.abc import Generator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions.hashing import subtree

_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|[^\W\d]\w*|\$\w+|\d[\w.]*|->|::|[-+*/%&|^=!<>]=|&&|\|\||\+\+|--|\S", re.S)
CONTROL = {"if": "IfStmt", "for": "ForStmt", "while": "WhileStmt", "do": "DoStmt", "switch": "SwitchStmt", "try": "TryStmt", "synchronized": "SynchronizedStmt"}
SIMPLE = {"return": "ReturnStmt", "throw": "ThrowStmt", "break": "BreakStmt", "continue": "ContinueStmt"}
TYPES = ("class", "interface", "enum", "record")


@dataclass
class Node:
    label: str
    begin: int
    end: int = 0
    name: str = ""
    first: int = 0  # tokens
    last: int = 0
    kids: list[Node] = field(default_factory=list)


def tokens(source: str) -> list[tuple[str, int]]:
    """(token, line) without comments; lines from 1."""
    out, line, place = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", place, m.start())
        place = m.start()
        if not m[0].startswith(("//", "/*")):
            out.append((m[0], line))
    return out


def walk(step: Generator) -> Any:
    """The result of a generator that yields generators for its parts and is sent their results."""
    stack, value = [step], None
    while stack:
        try:
            part = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(part)
            value = None
    return value


class Parser:
    """member(), block() and statement() are generators for walk()."""

    def __init__(self, source: str):
        self.t = tokens(source)
        self.i = 0

    def parse(self) -> Node:
        root = Node("CompilationUnit", 1, self.t[-1][1] if self.t else 1, last=len(self.t))
        while self.i < len(self.t):
            if self.t[self.i][0] == "}":
                self.i += 1
            else:
                root.kids.append(walk(self.member()))
        return root

    def _close(self, node: Node) -> Node:
        node.last = self.i
        node.end = self.t[min(self.i, len(self.t)) - 1][1] if self.t else node.begin
        return node

    def member(self) -> Generator:
        """A type, method, field or import at the cursor."""
        start, depth, paren = self.i, 0, -1
        seen, places = start, {}  # the first places of the words that decide, up to the cursor
        node = Node("FieldDeclaration", self.t[start][1], first=start)
        while self.i < len(self.t):
            tok = self.t[self.i][0]
            if tok == "(" and depth == 0 and paren < 0:
                paren = self.i
            depth += (tok == "(") - (tok == ")")
            if depth <= 0 and tok in ("{", ";", "}"):
                for at in range(seen, self.i):
                    if self.t[at][0] in ("=", *TYPES):
                        places.setdefault(self.t[at][0], at)
                seen = self.i
                kind = next((k for k in TYPES if k in places), None)
                if tok == "{" and kind and "=" not in places:
                    node.label = "ClassOrInterfaceDeclaration" if kind in ("class", "interface") else f"{kind.title()}Declaration"
                    node.name = self.t[places[kind] + 1][0] if places[kind] + 1 < self.i else ""
                    self.i += 1
                    while self.i < len(self.t) and self.t[self.i][0] != "}":
                        node.kids.append((yield self.member()))
                    self.i += 1
                    return self._close(node)
                if paren > start and places.get("=", paren) >= paren and tok in "{;":
                    node.label, node.name = "MethodDeclaration", self.t[paren - 1][0]
                    if tok == "{":
                        node.kids.append((yield self.block()))
                    else:
                        self.i += 1
                    return self._close(node)
                if tok == "{":
                    yield self.block()
                    continue
                if tok == "}":
                    return self._close(node)
                self.i += 1
                if self.i > start + 1 and self.t[start][0] in ("import", "package"):
                    node.label = f"{self.t[start][0].title()}Declaration"
                return self._close(node)
            self.i += 1
        return self._close(node)

    def block(self) -> Generator:
        node = Node("BlockStmt", self.t[self.i][1], first=self.i)
        self.i += 1
        while self.i < len(self.t) and self.t[self.i][0] != "}":
            node.kids.append((yield self.statement()))
        self.i += 1
        return self._close(node)

    def statement(self) -> Generator:
        tok, line = self.t[self.i]
        if tok == "{":
            return (yield self.block())
        node = Node(CONTROL.get(tok) or SIMPLE.get(tok) or "ExpressionStmt", line, first=self.i)
        if tok in CONTROL:
            self.i += 1
            if self.i < len(self.t) and self.t[self.i][0] == "(":
                self._skip()
            if self.i < len(self.t):
                node.kids.append((yield self.statement()))
            while self.i < len(self.t) and (self.t[self.i][0] in ("catch", "finally") and tok == "try" or self.t[self.i][0] == "else" and tok == "if" or self.t[self.i][0] == "while" and tok == "do"):
                word = self.t[self.i][0]
                self.i += 1
                if self.i < len(self.t) and self.t[self.i][0] == "(":
                    self._skip()
                if word == "while":
                    self.i += self.i < len(self.t) and self.t[self.i][0] == ";"
                elif self.i < len(self.t):
                    node.kids.append((yield self.statement()))
            return self._close(node)
        depth = 0
        while self.i < len(self.t):
            x = self.t[self.i][0]
            depth += (x in "([{") - (x in ")]}")
            if depth < 0:
                break
            self.i += 1
            if depth == 0 and x == ";":
                break
        if node.label == "ExpressionStmt" and re.match(r"(?:final )?[A-Za-z_][\w.]*(?: ?<.*>)?(?: ?\[ ?\])* \w+ (?:=|;)", " ".join(w for w, _ in self.t[node.first : self.i])):
            node.label = "VariableDeclarationStmt"
        return self._close(node)

    def _skip(self) -> None:
        depth = 0
        while self.i < len(self.t):
            depth += (self.t[self.i][0] == "(") - (self.t[self.i][0] == ")")
            self.i += 1
            if depth == 0:
                return


NODE = T.StructType([
    T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("ordinal", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("label", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("begin_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("subtree_size", T.IntegerType()), T.StructField("in_method", T.BooleanType()),
    T.StructField("tokens", T.ArrayType(T.StringType())),
])
_NODE_PA = pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("ordinal", pa.int32()), ("depth", pa.int32()), ("label", pa.string()), ("name", pa.string()), ("begin_line", pa.int32()), ("end_line", pa.int32()), ("subtree_size", pa.int32()), ("in_method", pa.bool_()), ("tokens", pa.list_(pa.string()))])


def flatten(source: str) -> list[dict]:
    """Nodes of a source in pre-order."""
    parser, out = Parser(source), []
    todo: list[tuple[Node, int | None, int, int, bool]] = [(parser.parse(), None, 0, 0, False)]
    while todo:
        node, parent, ordinal, depth, inside = todo.pop()
        at = len(out)
        row = {"node_id": at, "parent_id": parent, "ordinal": ordinal, "depth": depth, "label": node.label, "name": node.name, "begin_line": node.begin, "end_line": node.end, "in_method": inside, "subtree_size": 1}
        row["tokens"] = [t for t, _ in parser.t[node.first : node.last]] if not node.kids else []
        out.append(row)
        within = inside or node.label == "MethodDeclaration"
        todo.extend((k, at, i, depth + 1, within) for i, k in reversed(list(enumerate(node.kids))))
    for row in reversed(out[1:]):
        out[row["parent_id"]]["subtree_size"] += row["subtree_size"]
    return out


def parse_column(source: Column) -> Column:
    """array<struct> of nodes of a source text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([flatten(x.as_py() or "") for x in texts], pa.list_(_NODE_PA))

    return F.arrow_udf(run, T.ArrayType(NODE))(source)


def ast_nodes(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    return files.select(key, F.explode(parse_column(F.col(text))).alias("n")).select(key, "n.*")


def methods(nodes: DataFrame, key: str = "file_id") -> DataFrame:
    """Methods with an occurrence number for each name, so that overloads keep apart."""
    order = F.row_number().over(Window.partitionBy(key, "name").orderBy("node_id")) - 1
    found = nodes.where("label = 'MethodDeclaration'").withColumn("occurrence", order)
    return found.select(key, F.concat_ws("#", "name", F.col("occurrence").cast("string")).alias("method_id"), "name", "begin_line", "end_line", "subtree_size")


def linearised(nodes: DataFrame, key: str = "file_id", outside_methods: bool = False) -> DataFrame:
    """(key, labels): node labels and leaf tokens in pre-order; optionally without what is inside methods."""
    kept = nodes.where(~F.col("in_method") & (F.col("label") != "MethodDeclaration") & (F.col("node_id") > 0)) if outside_methods else nodes
    rows = kept.select(key, F.struct("node_id", F.concat(F.array(F.concat(F.lit("N:"), "label")), F.transform("tokens", lambda t: F.concat(F.lit("L:"), t))).alias("w")).alias("x"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x")).select(key, F.flatten(F.transform("x", lambda x: x["w"])).alias("labels"))


def external_calls(tokens_by_file: DataFrame, nodes: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, call): names that are called but not declared in the same file."""
    spots = tokens_by_file.select(key, F.posexplode("tokens").alias("p", "t"))
    order = Window.partitionBy(key).orderBy("p")
    called = spots.withColumn("n", F.lead("t").over(order)).where((F.col("n") == "(") & F.col("t").rlike("^[A-Za-z_]") & ~F.col("t").isin("if", "for", "while", "switch", "catch", "synchronized", "return", "new"))
    declared = nodes.where("label = 'MethodDeclaration'").select(key, F.col("name").alias("t"))
    return called.select(key, "t").distinct().join(declared, [key, "t"], "left_anti").withColumnRenamed("t", "call")


def tree_profile(nodes: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, nodes, methods, largest, median, trivial): sizes of a file's tree and its methods; the median is the mean of the middle two."""
    size = F.when(F.col("label") == "MethodDeclaration", F.col("subtree_size"))
    return nodes.groupBy(key).agg(
        F.count("*").alias("nodes"), F.count(size).alias("methods"), F.coalesce(F.max(size), F.lit(0)).alias("largest"),
        F.coalesce(F.percentile(size, F.lit(0.5)), F.lit(0.0)).alias("median"), F.count_if(size <= 8).alias("trivial"),
    )


STATEMENTS = ("ExpressionStmt", "VariableDeclarationStmt", *SIMPLE.values(), *CONTROL.values())


def tree_regions(nodes: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, region_id, kind, begin_line, end_line): files, methods, bodies, control statements, and blocks of two statements or more."""
    children = nodes.where(F.col("label").isin(*STATEMENTS)).groupBy(key, F.col("parent_id").alias("node_id")).agg(F.count("*").alias("stmts"))
    parents = nodes.select(key, F.col("node_id").alias("parent_id"), F.col("label").alias("above"))
    joined = nodes.join(children, [key, "node_id"], "left").join(parents, [key, "parent_id"], "left")
    block = F.col("label") == "BlockStmt"
    kinds = F.array_compact(
        F.array(
            F.when(F.col("label") == "CompilationUnit", "FILE"), F.when(F.col("label") == "MethodDeclaration", "METHOD"), F.when(block & (F.col("above") == "MethodDeclaration"), "METHOD_BODY_REGION"),
            F.when(block & (F.col("stmts") >= 2), "BLOCK_SEQUENCE_REGION"), F.when(F.col("label").isin(*CONTROL.values()), "CONTROL_REGION"),
        )
    )
    found = joined.select(key, "node_id", "begin_line", "end_line", F.explode(kinds).alias("kind"))
    return found.select(key, F.concat_ws(":", "kind", F.col("node_id").cast("string")).alias("region_id"), "kind", "begin_line", "end_line")


def region_of_lines(nodes: DataFrame, lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, region, node_id, begin_line, end_line): outermost statements that overlap a region's lines (key, region, line)."""
    hit = lines.groupBy(key, "region").agg(F.collect_set("line").alias("ls")).join(nodes.where(F.col("label").isin(*STATEMENTS)), key)
    hit = hit.where(F.exists("ls", lambda x: (x >= F.col("begin_line")) & (x <= F.col("end_line")))).select(key, "region", "node_id", "subtree_size", "begin_line", "end_line")
    # In pre-order a node lies inside another if its number falls into the other's subtree: the furthest end so far tells.
    order = Window.partitionBy(key, "region").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("node_id") + F.col("subtree_size")).over(order)
    return hit.withColumn("_reach", F.coalesce(reach, F.lit(-1))).where("node_id >= _reach").drop("_reach", "subtree_size")


def own_tokens(nodes: DataFrame, tokens: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, node_id, pos, tok): tokens of a statement that no nested statement holds. tokens: (key, pos, tok, node_id of the innermost statement)."""
    kept = nodes.where(F.col("label").isin(*STATEMENTS)).select(key, "node_id")
    return tokens.join(kept, [key, "node_id"], "left_semi").select(key, "node_id", "pos", "tok")


def _shape(rows: list[dict]) -> list[list[int]]:
    """Children (positions) of each of a pre-order list of nodes with depths."""
    kids: list[list[int]] = [[] for _ in rows]
    open_: list[int] = []
    for i, r in enumerate(rows):
        while open_ and rows[open_[-1]]["depth"] >= r["depth"]:
            open_.pop()
        if open_:
            kids[open_[-1]].append(i)
        open_.append(i)
    return kids


def postorder(rows: list[dict]) -> list[tuple[int, str]]:
    """(leftmost leaf, label) in postorder, from nodes in pre-order with depth and label."""
    kids, number, out = _shape(rows), {}, []
    for i in _after(kids):
        leaf = number[kids[i][0]][1] if kids[i] else len(out)
        number[i] = (len(out), leaf)
        out.append((leaf, rows[i]["label"]))
    return out


def _after(kids: list[list[int]]) -> list[int]:
    """Positions in postorder, children before their parent."""
    out, stack = [], [0] if kids else []
    while stack:
        i = stack.pop()
        out.append(i)
        stack.extend(kids[i])
    return out[::-1]


def subtree_hashes(rows: list[dict], least: int = 3) -> set[int]:
    """Hashes of all subtrees of ``least`` nodes or more, from nodes in pre-order."""
    kids = _shape(rows)
    done: dict[int, tuple[int, int]] = {}
    for i in _after(kids):
        done[i] = (subtree(rows[i]["label"], [done[k][0] for k in kids[i]]), 1 + sum(done[k][1] for k in kids[i]))
    return {h for h, n in done.values() if n >= least}
