"""Functions and classes of source files with their metrics: one Python pass over files, rows out.

Regular-expression languages share one extractor driven by a table of patterns;
Python uses its own syntax tree. A file is a row (path, language, code), so the
work spreads with the files; nothing is shuffled. Unknown languages and files
that don't parse give no rows.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.detectors import METRICS

SCHEMA = "location string, name string, item_type string, line int, ast_hash string, " + ", ".join(f"{m} int" for m in METRICS)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
MOST_BYTES = 500_000

# Patterns and names that decide what counts, by language.
EXTENSIONS = {"py": "python", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "c": "cpp", "hpp": "cpp", "h": "cpp", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "php": "php", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "rb": "ruby"}
ALIASES = {"py": "python", "rs": "rust", "golang": "go", "c++": "cpp", "c": "cpp", "c#": "csharp", "cs": "csharp", "kt": "kotlin", "ts": "typescript", "js": "typescript", "javascript": "typescript", "rb": "ruby"}
BRANCHING = [r"\bif\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\bcatch\b", r"\bexcept\b", r"\bswitch\b", r"\bcase\b", r"\bselect\b", r"\bmatch\b", r"\b&&\b", r"\|\|"]
TERNARY = r"\b\w+\s*\?\s*[^:\n]{1,50}:"
LOCALS = [r"\bvar\s+\w+", r"\w+\s*:=", r"\blet\s+\w+", r"\bconst\s+\w+"]
CALL, CHAINED, ACCESS, FORWARD = r"\w+\.\w+\s*\(", r"\.\w+\s*\(", r"\.\w+", r"(?m)^\s*(?:return\s+)?[@\w]+(?:\.\w+)+\s*\([^)]*\)\s*;"
OVERRIDES = [r"(?i)@override", r"\bsuper\(\)"]
CONTROL = {"if", "for", "while", "switch", "catch", "return", "class", "struct", "using", "lock", "function", "constructor"}


@dataclass(frozen=True)
class Language:
    function: str
    klass: str | None = None
    method: str | None = None
    member: str | None = None
    extra: list[str] = field(default_factory=list)
    local: list[str] = field(default_factory=lambda: LOCALS)
    primitive: str | None = None
    hash_comments: bool = False


#: Heads of C++ functions: words, marks and spaces from where they begin to a word with a parenthesis. No repetition can give back what it took, so text of any kind takes linear time.
CPP_HEAD = r"(?<![\w:*&<>\s])\s*+(?:\w++(?!\s*+\()|[:*&<>])(?:\w++(?!\s*+\()|[:*&<>\s])++(?<=[\s*&])(\w++)\s*+\("

LANGUAGES = {
    "java": Language(r"(?<=\s)[\w<>\[\]]++\s++(\w++)\s*+\(", r"(?:class|interface|enum)\s+(\w+)", r"(?:public|private|protected)\s+[\w<>\[\]]+\s+\w+\s*\(", r"(?:public|private|protected)\s+[\w<>\[\]]+\s+\w+\s*;", [r"\bdo\b", TERNARY, r"\btry\b"], primitive=r"\b(?:int|long|short|byte|float|double|boolean|char|Integer|Long|Short|Byte|Float|Double|Boolean|Character|String)\b"),
    "go": Language(r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", r"type\s+(\w+)\s+struct\s*\{", primitive=r"\b(?:int|int8|int16|int32|int64|uint|uint8|uint16|uint32|uint64|float32|float64|bool|string|byte|rune)\b"),
    "rust": Language(r"fn\s+(\w+)\s*[\(<]", r"struct\s+(\w+)", r"fn\s+\w+", r"\s+\w+\s*:\s*[A-Za-z]", [r"\bloop\b"], primitive=r"\b(?:i8|i16|i32|i64|i128|u8|u16|u32|u64|u128|f32|f64|bool|char|usize|isize|str)\b"),
    "cpp": Language(CPP_HEAD, r"(?:class|struct)\s+(\w+)\s*(?::\s*[^\{]*)?\{", r"(?<=[\w:*&<>])\s++\w++\s*+\(", r"(?:public|private|protected)\s++(?:\w++(?!\s*+;)|[:*&<>,])(?:\w++(?!\s*+;)|[:*&<>,\s])*+(?<=\s)\w++\s*+;", [r"\bdo\b", TERNARY, r"\btry\b"], [r"\b(?:int|double|float|bool|char|void|auto|long|short|unsigned|signed|size_t)\s+\w+\s*[=;]"]),
    "csharp": Language(r"(?:(?:public|private|protected|internal|static|virtual|override|async|abstract)\s+)+[\w<>\[\]?]+\s+(\w+)\s*\(", r"(?:class|struct|record)\s+(\w+)", r"(?:public|private|protected|internal)\s+[\w<>\[\]?]+\s+\w+\s*\(", r"(?:public|private|protected|internal|readonly)\s+[\w<>\[\]?]+\s+\w+\s*[;=]", [r"\bforeach\b", r"\bfrom\b", r"\bwhere\b", r"\bselect\b", TERNARY], [r"\b(?:int|string|bool|double|float|var|decimal|long|byte|char|short|uint|ulong|ushort)\s+\w+\s*[=;]"], r"\b(?:int|long|short|byte|float|double|decimal|bool|char|string|uint|ulong|ushort|sbyte|object|dynamic)\b"),
    "kotlin": Language(r"fun\s+(?:<[^>]*>\s*)?(\w+)\s*\(", r"class\s+(\w+)", r"fun\s+(?:<[^>]*>\s*)?\w+\s*\(", r"(?:val|var)\s+\w+", [r"\bwhen\b", r"\bis\b"], [r"\b(?:val|var)\s+\w+"], r":\s*(?:Int|Long|Short|Byte|Float|Double|Boolean|Char|String|Any|Unit|Nothing)\b"),
    "php": Language(r"function\s+(\w+)\s*\(", r"class\s+(\w+)", r"(?:public|private|protected|static)\s+function\s+\w+", r"(?:public|private|protected|static)\s+\$\w+", [r"\belseif\b", r"\bforeach\b", r"\bdo\b", TERNARY], [r"\$\w+\s*="], r"\b(?:int|float|bool|string|array|mixed|null|true|false|void|callable|iterable)\b", True),
    "typescript": Language(r"(?:function\s+(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::\s*[^=]+)?=>)", r"(?:class|interface)\s+(\w+)", r"(?m)^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*\w+\s*\([^)]*\)\s*(?::[^{]+)?\{", r"(?m)^\s+(?:public\s+|private\s+|protected\s+|readonly\s+)*\w+\??\s*:\s*[^;(){]+;", primitive=r":\s*(?:number|string|boolean|any|null|undefined|void|never|unknown)\b"),
}


def count(pattern: str, text: str) -> int:
    return sum(1 for _ in re.finditer(pattern, text))


def block(code: str, start: int) -> int:
    """The end of the brace block that opens at or after start, strings aside; -1 if there is none before a semicolon."""
    depth, k = 0, start
    while k < len(code):
        c = code[k]
        if c in "\"'`":
            k += 1
            while k < len(code) and code[k] != c and code[k] != "\n":
                k += 1 + (code[k] == "\\")
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return k + 1 if depth == 0 else -1
        elif c == ";" and depth == 0:
            return -1
        k += 1
    return -1


def parameters(text: str) -> list[str]:
    """The pieces between the commas of the first balanced parentheses."""
    at = text.find("(")
    if at < 0:
        return []
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if depth == 0:
            return [p.strip() for p in text[at + 1 : k].split(",") if p.strip()]
    return []


def longest_run(pattern: str, text: str, gap: int) -> int:
    """The most matches in a row with at most ``gap`` characters between neighbours; 0 for fewer than two matches."""
    spans = [m.span() for m in re.finditer(pattern, text)]
    if len(spans) < 2:
        return 0
    top = now = 1
    for (_, b), (c, _) in zip(spans, spans[1:]):
        now = now + 1 if c - b <= gap else 1
        top = max(top, now)
    return top


def lines_of_code(body: str) -> int:
    return sum(1 for x in body.splitlines() if x.strip() not in ("", "{", "}"))


def nesting(body: str) -> int:
    depth = top = 0
    for c in re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", " ", body):
        depth = max(0, depth + (c == "{") - (c == "}"))
        top = max(top, depth)
    return top


def strip_comments(code: str, hashes: bool) -> str:
    """Line comments and one-line block comments; block comments over several lines stay (the thresholds were set that way)."""
    code = re.sub(r"/\*.*?\*/", "", re.sub(r"//.*", "", code))
    return re.sub(r"#.*", "", code) if hashes else code


def comment_lines(raw: str) -> tuple[int, int]:
    """Comment lines, and those that are documentation."""
    own = [x.strip() for x in raw.splitlines()]
    return sum(x.startswith(("//", "/*", "*", "#")) for x in own), sum(x.startswith(("///", "/**")) for x in own)


def digest(body: str) -> str:
    """Equal for bodies that differ in layout only."""
    return hashlib.md5(" ".join(body.split()).encode()).hexdigest()


def measure(body: str, signature: str, lang: Language) -> dict[str, int]:
    given = parameters(signature)
    other = count(r"\belse\s+if\b", body)
    return {
        "loc": lines_of_code(body), "cyclomatic_complexity": 1 + sum(count(p, body) for p in [*BRANCHING, *lang.extra]), "nesting_depth": nesting(body),
        "parameter_count": len(given), "primitive_params": sum(bool(lang.primitive and re.search(lang.primitive, p)) for p in given),
        "local_variables": sum(count(p, body) for p in lang.local), "return_statements": count(r"\breturn\b", body), "external_calls": count(CALL, body),
        "branch_count": max(count(r"\bif\b", body), other) + count(r"\belif\b", body) + count(r"\bcase\b", body) + count("=>", body),
        "method_call_chains": max(longest_run(CHAINED, body, 15), longest_run(ACCESS, body, 0)),
    }


def brace_items(code: str, lang: Language) -> Iterator[dict]:
    clean = strip_comments(code, lang.hash_comments)
    remarks: dict[str, tuple[int, int]] = {}
    for m in re.finditer(lang.function, code):
        if (end := block(code, m.end() - 1)) > 0:
            remarks.setdefault(next(g for g in m.groups() if g), comment_lines(code[m.start() : end]))
    for m in re.finditer(lang.function, clean):
        name = next(g for g in m.groups() if g)
        end = block(clean, m.end() - 1)
        if name in CONTROL or end < 0:
            continue
        at = clean.find("{", m.end() - 1)
        body = clean[at:end]
        seen, docs = remarks.get(name, (0, 0))
        yield {"name": name, "item_type": "function", "line": clean.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1, "ast_hash": digest(body), "comment_count": seen, "doc_comment_count": docs, **measure(body, clean[m.end() - 1 if m[0][-1] in "(<" else m.start() : at], lang)}
    for m in re.finditer(lang.klass, clean) if lang.klass else ():
        end = block(clean, m.start())
        if end < 0:
            continue
        body = clean[clean.find("{", m.start()) : end]
        methods = count(lang.method, body) if lang.method else 0
        members = count(lang.member, body) if lang.member else 0
        if lang is LANGUAGES["go"]:
            methods = count(rf"func\s+\(\s*\w*\s*\*?{m[1]}\s*\)", clean)
            members = sum(1 for x in body.strip("{}").splitlines() if x.strip())
        if lang is LANGUAGES["rust"]:
            members = count(r"\w+\s*:\s*[A-Za-z&]", body)
            methods = sum(count(r"\bfn\s+\w+", clean[i.start() : block(clean, i.start())]) for i in re.finditer(rf"impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?{m[1]}\b", clean) if block(clean, i.start()) > 0)
        yield {"name": m[1], "item_type": "class", "line": clean.count("\n", 0, m.start()) + 1, "ast_hash": digest(body), "loc": lines_of_code(body), "cyclomatic_complexity": 1, "method_count": methods, "field_count": members, "delegation_methods": count(FORWARD, body), "override_count": sum(count(p, body) for p in OVERRIDES)}


def ruby_items(code: str) -> Iterator[dict]:
    """Blocks that open with def or class and close with their end, by indentation of the opening line."""
    clean = re.sub(r"(?m)#.*$", "", code)
    lines = clean.splitlines()
    for k, x in enumerate(lines):
        if not (m := re.match(r"(\s*)(def|class)\s+(?:self\.)?([\w?!]+)(.*)", x)):
            continue
        end = next((j for j in range(k + 1, len(lines)) if re.match(rf"{m[1]}end\b", lines[j])), len(lines) - 1)
        body = "\n".join(lines[k + 1 : end])
        opens = count(r"\b(?:if|unless|while|until|for|case|when|rescue|elsif)\b", body)
        base = {"name": m[3], "line": k + 1, "ast_hash": digest(body), "loc": lines_of_code(body)}
        if m[2] == "def":
            deep = max([0, *(len(y) - len(y.lstrip()) - len(m[1]) for y in lines[k + 1 : end] if y.strip())]) // 2
            yield base | {"item_type": "function", "cyclomatic_complexity": 1 + opens + count(r"&&|\|\|", body), "nesting_depth": deep, "parameter_count": len(parameters(m[4])), "return_statements": count(r"\breturn\b", body), "external_calls": count(r"\w+\.\w+", body), "branch_count": count(r"\b(?:if|unless|elsif|when)\b", body), "method_call_chains": longest_run(ACCESS, body, 0), "local_variables": count(r"(?m)^\s*\w+\s*=[^=]", body)}
        else:
            yield base | {"item_type": "class", "cyclomatic_complexity": 1, "method_count": count(r"(?m)^\s*def\s", body), "field_count": len(set(re.findall(r"@\w+", body))), "override_count": count(r"\bsuper\b", body)}


PRIMITIVES = {"int", "float", "str", "bool", "bytes", "complex", "None"}
COMPOUND = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith, ast.Match)


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes below, not entering nested functions or classes."""
    for x in ast.iter_child_nodes(node):
        if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield x
            yield from _own(x)


def _depth(body: list, level: int = 0) -> int:
    top = level
    for x in body:
        if isinstance(x, COMPOUND):
            for part in ("body", "orelse", "finalbody"):
                top = max(top, _depth(getattr(x, part, []), level + 1))
            for h in [*getattr(x, "handlers", []), *getattr(x, "cases", [])]:
                top = max(top, _depth(h.body, level + 1))
    return top


def _chain(x: ast.AST) -> int:
    n = 0
    while isinstance(x, (ast.Call, ast.Attribute)):
        n += isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute)
        x = x.func if isinstance(x, ast.Call) else x.value
    return n


def _code_lines(node: ast.AST, lines: list[str]) -> tuple[int, int, int]:
    """Lines of code without docstring and comments (at least 1), comment lines with docstring lines, docstring lines."""
    own = lines[node.lineno - 1 : node.end_lineno]
    first = node.body[0]
    doc = first.end_lineno - first.lineno + 1 if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else 0
    marks = sum(x.strip().startswith("#") for x in own)
    return max(1, sum(bool(x.strip()) for x in own) - marks - doc), marks + doc, doc


def python_items(code: str) -> Iterator[dict]:
    lines = code.splitlines()

    def walk(body: list) -> Iterator[dict]:
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield function(x)
                yield from walk(x.body)
            elif isinstance(x, ast.ClassDef):
                yield klass(x)
                yield from walk(x.body)

    def function(x) -> dict:
        nodes = list(_own(x))
        given = [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs]
        cc = 1
        for y in nodes:
            cc += isinstance(y, (ast.If, ast.For, ast.While, ast.AsyncFor)) + (1 + len(y.handlers) if isinstance(y, ast.Try) else 0) + (1 + len(y.cases) if isinstance(y, ast.Match) else 0)
        loc, comments, docs = _code_lines(x, lines)
        names = {t.id for y in nodes if isinstance(y, (ast.Assign, ast.AnnAssign, ast.For, ast.NamedExpr)) for t in (y.targets if isinstance(y, ast.Assign) else [y.target]) if isinstance(t, ast.Name)}
        plain = [a for a in given if a.arg not in ("self", "cls") and (a.annotation is None or isinstance(a.annotation, ast.Name) and a.annotation.id in PRIMITIVES)]
        calls = [y for y in nodes if isinstance(y, ast.Call) and isinstance(y.func, ast.Attribute)]
        returned = {id(z) for y in nodes if isinstance(y, ast.Return) and y.value for z in ast.walk(y.value)}
        chains = [_chain(y.value) for y in x.body if isinstance(y, (ast.Expr, ast.Assign))]
        return {"name": x.name, "item_type": "function", "line": x.lineno, "ast_hash": hashlib.md5(ast.dump(ast.Module(x.body, [])).encode()).hexdigest(), "loc": loc, "cyclomatic_complexity": cc, "nesting_depth": _depth(x.body), "parameter_count": len(given), "primitive_params": len(plain), "local_variables": len(names), "return_statements": sum(isinstance(y, ast.Return) for y in nodes), "external_calls": sum(id(y) not in returned for y in calls), "branch_count": sum(isinstance(y, ast.If) for y in nodes) + sum(len(y.cases) for y in nodes if isinstance(y, ast.Match)), "method_call_chains": max([0, *chains]), "comment_count": comments, "doc_comment_count": docs}

    def klass(x: ast.ClassDef) -> dict:
        methods = [y for y in x.body if isinstance(y, (ast.FunctionDef, ast.AsyncFunctionDef))]
        members = {t.id for y in x.body if isinstance(y, (ast.Assign, ast.AnnAssign)) for t in (y.targets if isinstance(y, ast.Assign) else [y.target]) if isinstance(t, ast.Name)}
        members |= {t.attr for f in methods for y in _own(f) if isinstance(y, (ast.Assign, ast.AnnAssign)) for t in (y.targets if isinstance(y, ast.Assign) else [y.target]) if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"}

        def forwards(f) -> bool:
            body = f.body[1:] if ast.get_docstring(f) is not None else f.body
            value = body[0].value if len(body) == 1 and isinstance(body[0], (ast.Return, ast.Expr)) else None
            return isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and isinstance(value.func.value, ast.Attribute)

        loc, comments, docs = _code_lines(x, lines)
        over = sum(not (f.name.startswith("__") and f.name.endswith("__")) for f in methods) if x.bases else 0
        return {"name": x.name, "item_type": "class", "line": x.lineno, "ast_hash": hashlib.md5(ast.dump(ast.Module(x.body, [])).encode()).hexdigest(), "loc": loc, "cyclomatic_complexity": 1, "method_count": len(methods), "field_count": len(members), "delegation_methods": sum(map(forwards, methods)), "comment_count": comments, "doc_comment_count": docs, "override_count": over}

    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return
    yield from walk(tree.body)


def extract(code: str | None, language: str | None) -> Iterator[dict]:
    """Items of one file; nothing for unknown languages; of more than MOST_BYTES bytes one item of type 'rejected'."""
    name = (language or "python").lower()
    name = ALIASES.get(name, name)
    if not code:
        return
    if len(code.encode("utf-8", "replace")) > MOST_BYTES:
        yield {"line": 1, "name": f"more than {MOST_BYTES} bytes", "item_type": "rejected"}
        return
    if name == "python":
        yield from python_items(code)
    elif name == "ruby":
        yield from ruby_items(code)
    elif name in LANGUAGES:
        yield from brace_items(code, LANGUAGES[name])


def code_items(files: DataFrame) -> DataFrame:
    """From (path, language, code): one row for each function and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: list[list] = [[] for _ in NAMES]
            for path, language, code in zip(*(x.column(k).to_pylist() for k in range(3))):
                for item in extract(code, language):
                    for k, n in enumerate(NAMES):
                        out[k].append(f"{path}:{item['line']}" if n == "location" else item.get(n, None if n == "ast_hash" else 0))
            kinds = [pa.string() if n in ("location", "name", "item_type", "ast_hash") else pa.int32() for n in NAMES]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds)], NAMES)

    return files.select("path", "language", "code").mapInArrow(run, SCHEMA)


def source_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, language, code) of files below a folder, the language by extension; unknown extensions are skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("code"))
    by = F.create_map(*[F.lit(v) for p in EXTENSIONS.items() for v in p])
    return raw.withColumn("language", by[F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))]).filter("language is not null").select("path", "language", "code")
