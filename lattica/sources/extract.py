"""Extraction of symbols and unresolved references: one file in, many rows out.

Python files are parsed with the standard ``ast``; other languages go through a breadth tier of
patterns for definitions and calls. Both give rows of the same two tables.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.runtime import ship, spread, stored

NODE = pa.schema([
    ("id", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("owner", pa.string()), ("path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("signature", pa.string()), ("exported", pa.bool_()), ("origin", pa.string()), ("body_hash", pa.string()), ("chars", pa.int32()), ("body_text", pa.string()), ("arity", pa.int32()), ("variadic", pa.bool_()),
])
EDGE = pa.schema([
    ("source", pa.string()), ("relation", pa.string()), ("file", pa.string()), ("target_id", pa.string()), ("specifier", pa.string()), ("name", pa.string()),
    ("via_member", pa.bool_()), ("recv_type", pa.string()), ("arg_count", pa.int32()), ("ord", pa.int32()),
])
#: Characters of searchable text kept of a symbol and of the rest of its file.
BODY_CHARS, RESIDUAL_CHARS = 5000, 16_000
#: Rows, or characters of text read, after which a batch is handed on.
BATCH_ROWS, BATCH_TEXT = 4096, 4_000_000
_DDL = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}


def search_body(text: str, most: int = BODY_CHARS) -> str:
    return " ".join(text.split())[:most]


class Rows:
    """Rows of one file, with ids minted in document order."""

    def __init__(self, path: str, text: str, origin: str):
        self.path, self.lines, self.origin = path, text.split("\n"), origin
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.taken: set[str] = set()
        self.add(path, path.rpartition("/")[2], "file", None, 1, len(self.lines))

    def mint(self, base: str) -> str:
        out, n = base, 1
        while out in self.taken:
            n += 1
            out = f"{base}~{n}"
        self.taken.add(out)
        return out

    def add(self, base: str, name: str, kind: str, owner: str | None, start: int, end: int, signature: str | None = None, exported: bool = True, arity: int | None = None, variadic: bool | None = None) -> str:
        body = "\n".join(self.lines[start - 1 : end])
        new = self.mint(base)
        self.nodes.append(dict(id=new, name=name, kind=kind, owner=owner, path=self.path, start_line=start, end_line=end, signature=signature, exported=exported, origin=self.origin, body_hash=hashlib.sha256(body.encode("utf-8", "replace")).hexdigest(), chars=len(body), body_text=search_body(body), arity=arity, variadic=variadic))
        return new

    def close(self) -> Rows:
        """The file row gets the text of the lines in no symbol's span."""
        inside = [False] * (len(self.lines) + 1)
        for n in self.nodes[1:]:
            inside[n["start_line"] : n["end_line"] + 1] = [True] * (n["end_line"] + 1 - n["start_line"])
        self.nodes[0]["body_text"] = search_body(" ".join(line for i, line in enumerate(self.lines, 1) if not inside[i]), RESIDUAL_CHARS)
        return self

    def link(self, source: str, relation: str, **what) -> None:
        self.edges.append(dict.fromkeys(EDGE.names) | dict(source=source, relation=relation, file=self.path, ord=len(self.edges)) | what)


class _Python(ast.NodeVisitor):
    def __init__(self, rows: Rows):
        self.rows, self.scope, self.names, self.types = rows, [(rows.path, None)], [], [{}]

    def _definition(self, node, kind: str) -> None:
        parent, owner = self.scope[-1]
        dotted = ".".join([*self.names, node.name])
        head = " ".join(self.rows.lines[node.lineno - 1].split()).rstrip(":").strip()
        args = getattr(node, "args", None)
        fixed = args and not args.defaults and not any(d is None for d in args.kw_defaults)  # with defaults several counts fit: unknown
        count = len(args.posonlyargs) + len(args.args) - bool(owner) if fixed else None
        new = self.rows.add(f"{self.rows.path}#{dotted}", node.name, kind, owner, node.lineno, node.end_lineno, head, not node.name.startswith("_"), count, bool(args.vararg) if args else None)
        self.rows.link(parent, "contains", target_id=new)
        for base in getattr(node, "bases", ()):
            if name := _last(base):
                self.rows.link(new, "extends", name=name)
        self.scope.append((new, node.name if kind == "class" else None))
        self.names.append(node.name)
        self.types.append(dict(self.types[-1]) | ({"self": owner, "cls": owner} if owner else {}))
        if args:
            for a in [*args.posonlyargs, *args.args, *args.kwonlyargs]:
                if a.annotation is not None and (kind_ := _last(a.annotation)):
                    self.types[-1][a.arg] = kind_
        for child in node.body:
            self.visit(child)
        self.types.pop()
        self.names.pop()
        self.scope.pop()

    def visit_ClassDef(self, node):
        self._definition(node, "class")

    def visit_FunctionDef(self, node):
        self._definition(node, "method" if self.scope[-1][1] else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node):
        if isinstance(node.value, ast.Call) and (made := _last(node.value.func)) and made[:1].isupper():
            for target in node.targets:
                if isinstance(target, ast.Name):
                    self.types[-1][target.id] = made
        self.generic_visit(node)

    def visit_Import(self, node):
        for alias in node.names:
            self.rows.link(self.rows.path, "imports", specifier=alias.name)

    def visit_ImportFrom(self, node):
        self.rows.link(self.rows.path, "imports", specifier="." * node.level + (node.module or ""))
        for alias in node.names if node.level and not node.module else ():  # each may be a module beside this one
            if alias.name != "*":
                self.rows.link(self.rows.path, "imports", specifier="." * node.level + alias.name)

    def visit_Call(self, node):
        if name := _last(node.func):
            member = isinstance(node.func, ast.Attribute)
            receiver = node.func.value.id if member and isinstance(node.func.value, ast.Name) else None
            self.rows.link(self.scope[-1][0], "calls", name=name, via_member=member, recv_type=self.types[-1].get(receiver), arg_count=None if node.keywords or any(isinstance(a, ast.Starred) for a in node.args) else len(node.args))
        self.generic_visit(node)


def _last(node) -> str | None:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value.rpartition(".")[2]
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


_DEFINES = re.compile(
    r"^[ \t]*(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|open|override|virtual|inline|unsafe|extern|const)\s+)*"
    r"(?P<word>class|interface|struct|enum|trait|module|namespace|object|type|func|function|fn|def|fun|sub)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_$][\w$]*)",
    re.M,
)
_KINDS = {"class": "class", "object": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait", "module": "module", "namespace": "module", "type": "type"}
_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLED = frozenset("if for while switch return catch function func fn def fun sub sizeof elif match with new throw await typeof and or not in is".split())
_BROUGHT = re.compile(
    r"^[ \t]*(?:#include\s*[<\"]([^>\"\n]+)|(?:pub(?:\([^)\n]*\))?\s+)?use\s+([\w:\\]+)|(?:import|export)\s+[\w\s{},*$]*?\bfrom\s+['\"]([^'\"\n]+)|import\s+(?:[\w.]+\s+)?[\"']([^'\"\n]+)|import\s+(?:static\s+)?([\w.]+))"
    r"|(?<![\w$.])require\(\s*['\"]([^'\"\n]+)",
    re.M,
)
_GO_BLOCK, _QUOTED = re.compile(r"^import\s*\(([^)]*)\)", re.M), re.compile(r"^\s*(?:[\w.]+\s+)?\"([^\"\n]+)\"", re.M)
_HERITAGE = re.compile(r"\b(extends|implements)\s+([\w.$\\\s,]+?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)")


def _breadth(rows: Rows, text: str) -> None:
    starts = [0]
    for line in rows.lines:
        starts.append(starts[-1] + len(line) + 1)
    from bisect import bisect_right

    at = lambda offset: bisect_right(starts, offset)
    found = list(_DEFINES.finditer(text))
    spans, heads = [], set()
    for m in found:
        start = at(m.start("name"))
        end = _block_end(rows.lines, start)
        kind = _KINDS.get(m["word"], "function")
        heads.add(m.start("name"))
        spans.append((start, end, rows.add(f"{rows.path}#{m['name']}", m["name"], kind, None, start, end, " ".join(m.group().split()))))
        rows.link(rows.path, "contains", target_id=spans[-1][2])
        if kind in ("class", "interface", "struct", "enum"):
            header = re.split(r"[{;]", text[m.end() : m.end() + 1000], maxsplit=1)[0]
            while (flat := re.sub(r"<[^<>]*>", " ", header)) != header:
                header = flat
            for relation, names in _HERITAGE.findall(header.strip()):
                for name in names.split(","):
                    if name := re.split(r"[.\\]", name.strip())[-1]:
                        rows.link(spans[-1][2], relation, name=name)
    for m in _CALL.finditer(text):
        if m[1] not in _NOT_CALLED and m.start(1) not in heads:
            line = at(m.start(1))
            inside = [s for s in spans if s[0] <= line <= s[1]]
            rows.link(min(inside, key=lambda s: s[1] - s[0])[2] if inside else rows.path, "calls", name=m[1], via_member=False)
    for m in _BROUGHT.finditer(text):
        rows.link(rows.path, "imports", specifier=next(g for g in m.groups() if g))
    for block in _GO_BLOCK.finditer(text) if rows.path.endswith(".go") else ():
        for m in _QUOTED.finditer(block[1]):
            rows.link(rows.path, "imports", specifier=m[1])


def _block_end(lines: list[str], start: int) -> int:
    """The line that closes the first brace from ``start`` on, or the end of the indented block.

    A brace that isn't closed within 5,000 lines counts as unbalanced, and the indentation decides.
    """
    depth, seen = 0, False
    for n in range(start, min(len(lines), start + 5000) + 1):
        depth += lines[n - 1].count("{") - lines[n - 1].count("}")
        seen = seen or "{" in lines[n - 1]
        if seen and depth <= 0:
            return n
        if not seen and n > start:
            break
    indent = len(lines[start - 1]) - len(lines[start - 1].lstrip())
    end = start
    for n in range(start + 1, len(lines) + 1):
        line = lines[n - 1]
        if line.strip() and len(line) - len(line.lstrip()) <= indent:
            break
        end = n if line.strip() else end
    return end


def extract_file(path: str, text: str) -> Rows:
    """Rows of one file; a Python file that doesn't parse has its file row alone."""
    if path.endswith(".py"):
        rows = Rows(path, text, "ast")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return rows.close()
        _Python(rows).visit(tree)
        return rows.close()
    rows = Rows(path, text, "pattern")
    _breadth(rows, text)
    return rows.close()


def _rows(files: DataFrame, *what: tuple[str, pa.Schema]) -> DataFrame:
    """A column of structs for each of ``what`` (``nodes``, ``edges``), of which every row has one.

    Parsing costs far more than reading, so files are spread by path over all cores, however few parts they
    were read in; and many small files share a batch, which costs more than the rows of one of them.
    """
    ship(files.sparkSession)
    kinds = [(pick, pa.struct(list(schema))) for pick, schema in what]

    def batch(held: dict[str, list[dict]]) -> pa.RecordBatch:
        size, columns, before = sum(map(len, held.values())), [], 0
        for pick, kind in kinds:
            own = held[pick]
            columns.append(pa.array([None] * before + own + [None] * (size - before - len(own)), kind))
            before += len(own)
        return pa.RecordBatch.from_arrays(columns, names=[pick for pick, _ in kinds])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[dict]] = {pick: [] for pick, _ in kinds}
        chars = count = 0
        for some in batches:
            for path, text in zip(some.column("path").to_pylist(), some.column("text").to_pylist()):
                rows = extract_file(path, text)
                for pick in held:
                    held[pick] += getattr(rows, pick)
                    count += len(getattr(rows, pick))
                chars += len(text)
                if count >= BATCH_ROWS or chars >= BATCH_TEXT:
                    yield batch(held)
                    held, chars, count = {pick: [] for pick in held}, 0, 0
        if count:
            yield batch(held)

    ddl = ", ".join(f"{pick} struct<{', '.join(f'{f.name}: {_DDL[f.type]}' for f in schema)}>" for pick, schema in what)
    return spread(files.where(F.col("text").isNotNull()).select("path", "text"), "path").mapInArrow(parse, ddl)


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, raw_edges)`` of files ``(path, text)``; null texts are left out."""
    return _rows(files, ("nodes", NODE)).select("nodes.*"), _rows(files, ("edges", EDGE)).select("edges.*")


def build(files: DataFrame, modules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)``: extraction, then resolution by the rule of one target or none.

    ``modules(module, dir)`` are the Go modules; by default those of the ``go.mod`` among ``files``.
    """
    from lattica.operators.resolve import build_imports, first_edges, resolve_names, typed_members
    from lattica.sources.files import go_modules

    rows = stored(_rows(files, ("nodes", NODE), ("edges", EDGE)))  # parsed once for all that is resolved from them
    nodes, raw = (rows.where(f"{pick} IS NOT NULL").select(f"{pick}.*") for pick in ("nodes", "edges"))
    numbered = raw.withColumn("ord", F.struct("file", "ord"))
    position = F.struct("path", "start_line", "id")
    symbols = nodes.where("kind <> 'file'").select("id", "name", F.col("path").alias("file"), position.alias("pos"), "owner", "kind", "arity", "variadic")
    fixed = numbered.where("target_id IS NOT NULL").select("ord", "source", "relation", F.col("target_id").alias("target"), F.lit("extracted").alias("confidence"))
    classes = symbols.where("kind IN ('class', 'interface', 'struct', 'trait')")
    heritage = numbered.where("relation IN ('extends', 'implements')")
    extended = resolve_names(heritage.where("relation = 'extends'").select("ord", "file", "name"), classes)
    known = extended.unionByName(resolve_names(heritage.where("relation = 'implements'").select("ord", "file", "name"), symbols.where("kind IN ('interface', 'trait')")))
    bases = heritage.join(known, "ord", "left").select("ord", "source", "relation", F.coalesce("target", "name").alias("target"), F.coalesce("confidence", F.lit("inferred")).alias("confidence"))
    calls = numbered.where("relation = 'calls'")
    lines = heritage.where("relation = 'extends'").join(nodes.select(F.col("id").alias("source"), F.col("name").alias("type")), "source").select("type", F.col("name").alias("parent"))
    typed = typed_members(calls.where("recv_type IS NOT NULL").select("ord", "recv_type", "name", "arg_count"), symbols.where("owner IS NOT NULL"), lines)
    plain = resolve_names(calls.where("NOT via_member").select("ord", "file", "name"), symbols.where("owner IS NULL"))
    called = calls.select("ord", "source", "relation").join(plain.unionByName(typed.withColumn("confidence", F.lit("extracted"))), "ord")
    brought = numbered.where("relation = 'imports'")
    inside = build_imports(brought.select("ord", "file", "specifier"), nodes.where("kind = 'file'").select("id"), go_modules(files) if modules is None else modules)
    confidence = F.when(F.col("target").isNull(), "inferred").otherwise("extracted")
    imports = brought.join(inside, "ord", "left").select("ord", "source", "relation", F.coalesce("target", "specifier").alias("target"), confidence.alias("confidence"))
    every = fixed.unionByName(bases).unionByName(called).unionByName(imports)
    return nodes, first_edges(every).select("source", "target", "relation", "confidence")
