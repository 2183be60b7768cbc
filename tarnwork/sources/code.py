"""Source-code parsing: Python by its syntax tree, other languages by a scanner.

The scanner blanks out comments and strings, finds declarations by what they begin with and
follows brackets from there: parameters, generics, return types and bodies are whole whatever
lines they take, and a call belongs to the innermost function whose body it stands in. It
builds no syntax tree, so what a macro or preprocessor makes stays unseen.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.text import LANGUAGES

FACTS = (
    "path string, kind string, name string, line int, container string, detail string, is_public boolean, is_async boolean, parameters array<string>, returns string, "
    "is_unsafe boolean, takes_mut_self boolean, takes_mut_params boolean, returns_result boolean, returns_option boolean, generic_count int"
)


@dataclass
class Fact:
    """A function, type, import, constant, member or call. detail is a type's keyword, a constant's
    value, a member's type or how a call is made; the flags are set for functions only."""

    path: str
    kind: str
    name: str
    line: int
    container: str | None = None
    detail: str | None = None
    is_public: bool | None = None
    is_async: bool | None = None
    parameters: list[str] | None = None
    returns: str | None = None
    is_unsafe: bool | None = None
    takes_mut_self: bool | None = None
    takes_mut_params: bool | None = None
    returns_result: bool | None = None
    returns_option: bool | None = None
    generic_count: int | None = None


@dataclass
class Function(Fact):
    body: tuple[int, int] = (0, 0)
    generics: list[str] = field(default_factory=list)


_VISIBLE = r"(?P<pub>pub(?:\([^)]*\))?\s+)?"
#: What a function begins with, up to its name.
_FUNCTION = {
    "rust": _VISIBLE + r"(?P<mods>(?:(?:const|async|unsafe|extern)\s+)*)fn\s+(?P<name>\w+)",
    "cairo": _VISIBLE + r"(?P<mods>)fn\s+(?P<name>\w+)",
    "go": r"^func\s+(?P<owner>\([^)]*\)\s*)?(?P<mods>)(?P<name>\w+)",
    "solidity": r"\b(?P<mods>)(?:function|modifier)\s+(?P<name>\w+)|\b(?P<made>constructor)(?=\s*\()",
    "javascript": r"(?P<pub>export\s+)?(?:default\s+)?(?P<mods>(?:async\s+)?)function\b\s*\*?\s*(?P<name>\w+)|(?P<pub2>export\s+)?\b(?:const|let|var)\s+(?P<arrow>\w+)\s*(?::[^=;{]+)?=\s*(?P<mods2>(?:async\s+)?)(?=(?:<[^>=]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={;]+)?=>)"
    r"|^[ \t]+(?P<mods3>(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*)\*?(?P<method>(?!(?:if|for|while|switch|catch|return|function|with|do|else|new|await|typeof|super)\b)[\w$]+)\s*(?=(?:<[^>(]*>)?\([^;{]*\)\s*(?::[^;{=]+)?\{)",
    "c": r"(?<![\w.>])(?P<name>(?!(?:if|for|while|switch|return|else|sizeof|catch|defined)\b)~?\w+)(?=\s*\([^;{}]*\)\s*\{)",
    "cpp": r"(?P<mods>)(?<![\w.>])(?P<name>(?!(?:if|for|while|switch|return|else|sizeof|catch|defined)\b)(?:\w+::)*~?\w+)(?=\s*\([^;{}]*\)\s*(?:(?:const|noexcept|override|final)\s*|->\s*[\w:<>&*\s]+|:[^;{}]*)*\{)",
}
_FUNCTION["typescript"] = _FUNCTION["javascript"]
_TYPE = {
    "rust": r"(?P<pub>pub(?:\([^)]*\))?\s+)?\b(?P<kind>struct|enum|trait|type|union)\s+(?P<name>\w+)", "cairo": r"(?P<pub>pub\s+)?\b(?P<kind>struct|enum|trait)\s+(?P<name>\w+)",
    "go": r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface|\w+)", "javascript": r"(?P<pub>export\s+)?(?:default\s+)?\b(?P<kind>class)\s+(?P<name>\w+)",
    "typescript": r"(?P<pub>export\s+)?(?:default\s+)?(?:abstract\s+)?(?:declare\s+)?\b(?P<kind>class|interface|type|enum)\s+(?P<name>\w+)(?=\s*[<{=]|\s+(?:extends|implements)\b)",
    "solidity": r"\b(?P<kind>contract|interface|library|struct|event|enum)\s+(?P<name>\w+)", "c": r"\b(?P<kind>struct|enum|union)\s+(?P<name>\w+)(?=\s*\{)", "cpp": r"\b(?P<kind>class|struct|enum|union)\s+(?:class\s+)?(?P<name>\w+)(?=[^;{}()]*\{)",
}
_IMPORT = {"rust": r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", "go": r"(?m)^\s*(?:import\s+)?(?:\w+\s+|_\s+|\.\s+)?\"([^\"\n]+)\"\s*$", "javascript": r"""(?m)^\s*(?:import|export)\b[^'";]*?['"]([^'"]+)['"]""", "cairo": r"(?m)^\s*use\s+([^;]+);", "c": r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)"}
_IMPORT["typescript"] = _IMPORT["solidity"] = _IMPORT["javascript"]
_CONSTANT = {"rust": r"\b(?:const|static)\s+(?:mut\s+)?([A-Z_]\w*)\s*:\s*[^=;]+=\s*([^;]+)", "go": r"(?m)^const\s+(\w+)[^=\n]*=\s*(.+)", "javascript": r"(?m)^(?:export\s+)?const\s+([A-Z][A-Z0-9_]*)\b[^=\n]*=\s*([^;]+)", "c": r"(?m)^#define\s+(\w+)[ \t]+(.+)", "solidity": r"\bconstant\s+(?:\w+\s+)*(\w+)\s*=\s*([^;]+)", "cairo": r"\bconst\s+(\w+)\s*:\s*[^=]+=\s*([^;]+)"}
_CONSTANT["typescript"] = _CONSTANT["javascript"]
for _table in (_IMPORT, _CONSTANT):
    _table["cpp"] = _table["c"]
_MEMBER = {"rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*(.+?),?\s*$", "go": r"(?m)^\s*(\w+)\s+([^\n`({]+?)\s*$", "typescript": r"(?m)^\s*(?:(?:public|private|protected|readonly|static)\s+)*(\w+)\??\s*:\s*([^;,{]+)[;,]?\s*$", "c": r"(?m)^\s*([\w\s*]+?[\s*])(\w+)(?:\[[^\]]*\])?\s*;"}
_MEMBER["cairo"], _MEMBER["cpp"], _MEMBER["solidity"] = _MEMBER["rust"], _MEMBER["c"], _MEMBER["c"]

_CALL = re.compile(r"(?<![\w.:])(?P<how>(?:go|defer|await|new|delete)\s+)?(?P<name>~?[A-Za-z_$][\w$]*(?:(?:::(?:<[^<>()]*>)?|\.|->|\?\.)\s*~?[\w$]+)*)(?P<macro>!)?\s*(?:::<[^<>()]*>|<[\w\s,]*>)?(?P<open>[(\[{])")
_NO_CALL = set("if for while switch match return fn func function catch sizeof new in const var type import else unsafe async await typeof delete throw case do with constructor defined go defer range".split())
_HOW = {"go": "goroutine", "defer": "defer", "await": "async", "new": "constructor", "delete": "destructor"}
_NOISE = {
    "rust": r'//[^\n]*|/\*.*?\*/|r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n]{1,8}?|[^\'\\\n])\'',
    "go": r'//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "javascript": r'//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "c": r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
}
_NOISE = {k: re.compile(v, re.S) for k, v in _NOISE.items()}
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def quiet(source: str, language: str, strings: bool = False) -> str:
    """The source with comments and strings blanked out, every character at its place; strings
    stay if told so."""
    blank = lambda m: m[0] if strings and m[0][0] != "/" else re.sub(r"[^\n]", " ", m[0])
    return _NOISE.get(language, _NOISE["javascript" if language == "typescript" else "c"]).sub(blank, source)


def closing(text: str, at: int) -> int:
    """Behind the bracket that closes the one at `at`; the end of the text if none does."""
    opener, depth = text[at], 0
    for i in range(at, len(text)):
        c = text[i]
        if c == opener:
            depth += 1
        elif c == _PAIRS[opener] and not (c == ">" and text[i - 1] in "-="):
            depth -= 1
            if not depth:
                return i + 1
    return len(text)


def parts(text: str) -> list[str]:
    """The text between commas that stand in no bracket."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1 : i] not in ("-", "=")):
            depth -= 1
        elif c == "," and depth <= 0:
            out.append(text[at:i])
            at = i + 1
    return [" ".join(x.split()) for x in [*out, text[at:]] if x.strip()]


def _flags(f: Function, language: str, method: bool, mods: str, tail: str, owner_is_const: bool) -> None:
    # What the flags of a function mean in each language.
    ret, ps = f.returns or "", f.parameters or []
    f.is_unsafe = language == "c" or (language == "rust" and "unsafe" in mods) or (language == "solidity" and "unchecked" in tail)
    f.takes_mut_self = {"rust": any("&mut self" in p for p in ps), "cpp": method and not owner_is_const, "javascript": method and "static" not in mods, "typescript": method and "static" not in mods}.get(language, False)
    f.takes_mut_params = {"rust": any("&mut " in p and "self" not in p for p in ps), "c": any("*" in p for p in ps), "cpp": any("const" not in p for p in ps), "solidity": bool(re.search(r"\bpayable\b", tail.split("{")[0]))}.get(language, False)
    f.returns_result = "Result" in ret if language in ("rust", "cairo") else "Promise" in ret if language == "typescript" else False
    f.returns_option = "Option" in ret if language in ("rust", "cairo") else any(x in ret for x in ("undefined", "null", "?")) if language == "typescript" else False
    counted = {"go": min(len(f.generics), 1), "rust": len(f.generics), "typescript": len(f.generics), "cpp": len(f.generics)}
    f.generic_count = counted.get(language, 0)


def _head(text: str, at: int) -> str:
    """What stands before a declaration of C or C++ since the last statement, block or directive."""
    since = 1 + max(text.rfind(c, 0, at) for c in ";{}")
    return re.sub(r"(?m)^\s*#.*$|\b(?:public|private|protected)\s*:(?!:)", " ", text[since:at])


def _function(path: str, language: str, text: str, source: str, m: re.Match, line: int) -> Function | None:
    g = m.groupdict()
    name = g.get("name") or g.get("arrow") or g.get("method") or g.get("made")
    mods = "".join(g.get(x) or "" for x in ("mods", "mods2", "mods3"))
    at, generics = m.end(), []
    rest = re.compile(r"\s*").match(text, at).end()
    if rest < len(text) and text[rest] in "<[" and (text[rest] == "<" or language == "go"):
        stop = closing(text, rest)
        generics, at = parts(source[rest + 1 : stop - 1]), stop
    opened = text.find("(", at)
    if opened < 0 or text[at:opened].strip():
        if language != "solidity":
            return None
        params, end = [], at
    else:
        end = closing(text, opened)
        params = parts(source[opened + 1 : end - 1])
    stop, depth = end, 0
    while stop < len(text) and not (depth == 0 and text[stop] in "{;"):
        depth += (text[stop] in "([") - (text[stop] in ")]")
        stop += 1
    signature = " ".join(source[end:stop].split())
    body = (stop, closing(text, stop)) if stop < len(text) and text[stop] == "{" else (stop, stop)
    if language in ("rust", "cairo"):
        returns = re.split(r"\bwhere\b", signature.removeprefix("->").strip())[0].strip() if signature.startswith("->") else ""
    elif language == "go":
        returns = signature
    elif language == "typescript":
        returns = signature.split("=>")[0].removeprefix(":").strip() if signature.startswith(":") else ""
    elif language == "solidity":
        found = re.search(r"returns\s*\(([^)]*)\)", signature)
        returns = found[1].strip() if found else ""
    elif language in ("c", "cpp"):
        head = _head(text, m.start())
        template = re.search(r"\btemplate\s*<", head)
        if template:
            stop = closing(head, template.end() - 1)
            generics, head = parts(head[template.end() : stop - 1]), head[stop:]
        returns = " ".join(w for w in head.split() if w not in ("static", "inline", "virtual", "extern", "constexpr", "explicit"))
    else:
        returns = ""
    public = {"go": name[:1].isupper(), "rust": bool(g.get("pub")), "cairo": bool(g.get("pub")), "javascript": True, "solidity": not re.search(r"\b(?:private|internal)\b", signature), "c": "static" not in _head(text, m.start()).split()}.get(language)
    if language == "typescript":
        public = not re.search(r"\b(?:private|protected)\b", mods) if g.get("method") else bool(g.get("pub") or g.get("pub2"))
    f = Function(path, "function", name, line, parameters=params, returns=returns or None, is_public=public, is_async="async" in mods, body=body, generics=generics)
    method = bool(g.get("method")) or (language == "cpp" and "::" in name)
    _flags(f, language, method, mods, signature + text[body[0] : body[1]], bool(re.search(r"\bconst\b", signature)))
    return f


def scanned_facts(path: str, source: str, language: str) -> list[Fact]:
    """Functions, types, members, imports, constants and calls of one text."""
    text = quiet(source, language)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect_right(lines, at)
    out: list[Fact] = []
    types: list[tuple[int, int, str]] = []
    for m in re.finditer(_TYPE[language], text, re.M):
        out.append(Fact(path, "type", m["name"], line_of(m.start("name")), detail=m["kind"], is_public=bool(m["pub"]) if "pub" in m.groupdict() else m["name"][:1].isupper() if language == "go" else None))
        stop = re.compile(r"[{;]").search(text, m.end() - 1)
        if stop and stop[0] == "{":
            types.append((stop.start(), closing(text, stop.start()), m["name"]))
    functions: list[Function] = []
    for m in re.finditer(_FUNCTION[language], text, re.M):
        f = _function(path, language, text, source, m, line_of(m.start() + len(m[0]) - len(m[0].lstrip())))
        if f and not (language in ("c", "cpp") and f.body[0] == f.body[1]):
            f.container = next((n for a, b, n in reversed(types) if a < m.start() < b), None)
            functions.append(f)
    out += functions
    for a, b, name in types:
        if language in _MEMBER:
            inside = text[a + 1 : b - 1]
            for f in functions:
                if a < f.body[0] < b:  # bodies within a type hold no members
                    inside = inside[: f.body[0] - a - 1] + re.sub(r"[^\n]", " ", inside[f.body[0] - a - 1 : f.body[1] - a - 1]) + inside[f.body[1] - a - 1 :]
            for m in re.finditer(_MEMBER[language], inside):
                one, two = (m[2], m[1]) if language in ("c", "cpp", "solidity") else (m[1], m[2])
                out.append(Fact(path, "member", one, line_of(a + 1 + m.start(1)), container=name, detail=" ".join(two.split())))
    for m in re.finditer(_IMPORT[language], quiet(source, language, strings=True)):
        out.append(Fact(path, "import", " ".join(m[1].split()), line_of(m.start(1))))
    for m in re.finditer(_CONSTANT[language], text):
        out.append(Fact(path, "constant", m[1], line_of(m.start(1)), detail=source[m.start(2) : m.end(2)].strip()))
    declared = {f.body[0]: f for f in functions}
    bodies = sorted(declared)
    for m in _CALL.finditer(text):
        name, how = re.sub(r"\s+", "", m["name"]), (m["how"] or "").strip()
        if (m["open"] != "(" and not m["macro"]) or name in _NO_CALL:
            continue
        owner = None
        for at in bodies[: bisect_right(bodies, m.start())]:
            f = declared[at]
            if at < m.start() < f.body[1]:
                owner = f
        if owner is None:
            continue
        awaited = how == "await" or (language == "rust" and text.startswith(".await", closing(text, m.start("open"))))
        kind = "macro" if m["macro"] else "async" if awaited else _HOW.get(how) or ("destructor" if "~" in name else "method" if re.search(r"\.|->", name) else "direct")
        out.append(Fact(path, "call", name + (m["macro"] or ""), line_of(m.start("name")), owner.name, kind))
    if language == "cpp":
        for m in re.finditer(r"\bdelete\s*(?:\[\s*\])?\s*(\w+)", text):
            owner = next((f for f in reversed(functions) if f.body[0] < m.start() < f.body[1]), None)
            if owner:
                out.append(Fact(path, "call", m[1], line_of(m.start()), owner.name, "destructor"))
    return out


def python_facts(path: str, source: str) -> list[Fact]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[Fact] = []

    def walk(node: ast.AST, owner: str | None, inside: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            now_owner, now_inside = owner, inside
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = [a.arg for a in (*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs)]
                returns = ast.unparse(x.returns) if x.returns else None
                told = returns or ""
                f = Fact(path, "function", x.name, x.lineno, owner, None, not x.name.startswith("_"), isinstance(x, ast.AsyncFunctionDef), args, returns)
                # What the flags mean in Python.
                f.is_unsafe, f.takes_mut_self, f.takes_mut_params, f.generic_count = False, "self" in args, False, 0
                f.returns_result, f.returns_option = any(w in told for w in ("Result", "Union", "Optional")), any(w in told for w in ("Optional", "None"))
                out.append(f)
                out.extend(Fact(path, "call", ast.unparse(dec).split("(")[0], dec.lineno, x.name, "decorator") for dec in x.decorator_list)
                now_inside = x.name
            elif isinstance(x, ast.ClassDef):
                out.append(Fact(path, "type", x.name, x.lineno, owner, "class", not x.name.startswith("_")))
                now_owner = x.name
            elif isinstance(x, ast.Import):
                out.extend(Fact(path, "import", a.name, x.lineno, None, a.asname) for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                out.append(Fact(path, "import", "." * x.level + (x.module or ""), x.lineno, None, ", ".join(a.name for a in x.names)))
            elif isinstance(x, ast.Assign) and isinstance(node, (ast.Module, ast.ClassDef)):
                for t in x.targets:
                    if isinstance(t, ast.Name):
                        kind = "constant" if t.id.isupper() else "member" if isinstance(node, ast.ClassDef) else None
                        if kind:
                            out.append(Fact(path, kind, t.id, x.lineno, owner, ast.unparse(x.value)))
            elif isinstance(x, ast.AnnAssign) and isinstance(node, ast.ClassDef) and isinstance(x.target, ast.Name):
                out.append(Fact(path, "member", x.target.id, x.lineno, owner, ast.unparse(x.annotation)))
            elif isinstance(x, ast.Call) and inside:
                kind = "async" if isinstance(node, ast.Await) else "method" if isinstance(x.func, ast.Attribute) else "direct"
                out.append(Fact(path, "call", ast.unparse(x.func), x.lineno, inside, kind))
            walk(x, now_owner, now_inside)

    walk(tree, None, None)
    return out


def parse_sources(files: DataFrame) -> DataFrame:
    """Facts of files(path, source); every file is parsed where it lies."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(Fact.__dataclass_fields__)
        for pdf in batches:
            rows = []
            for path, source in zip(pdf["path"], pdf["source"], strict=True):
                language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if source is not None else None
                if language == "python":
                    rows += python_facts(path, source)
                elif language:
                    rows += scanned_facts(path, source, language)
            table = [{n: x for n, x in asdict(r).items() if n in names} for r in rows]
            yield pd.DataFrame(table, columns=names).astype(object).where(lambda t: t.notna(), None)

    return files.select("path", "source").mapInPandas(parse, FACTS)


def ignore_regex(pattern: str, under: str = "") -> str:
    """The regex, over paths relative to the root, of one line of the ignore file in folder `under`."""
    anchored, folder = "/" in pattern.rstrip("/"), pattern.endswith("/")
    out, body, i = "", pattern.strip("/"), 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
    return "^" + re.escape(under) + ("" if anchored else "(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, lines: list[str] | list[tuple[str, str]]) -> Column:
    """Whether lines of ignore files leave a relative path out; a later line overrides, `!` takes back.

    Lines may be given with the folder (ending in `/`) of their file, the root's first.
    """
    out = F.lit(False)
    for under, line in (x if isinstance(x, tuple) else ("", x) for x in lines):
        line = line.rstrip()
        if line and not line.startswith("#"):
            back = line.startswith("!")
            out = F.when(path.rlike(ignore_regex(line[back:], under)), F.lit(not back)).otherwise(out)
    return out


#: Folders that are never read.
ALWAYS = [".git/", "node_modules/", "target/", "__pycache__/"]


def read_sources(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, size, mtime, line_count, source) of the text files of known languages below a
    folder, without what `ignore` (by default the .gitignore files in it) leaves out; a file in
    a folder goes before those above it."""
    if ignore is None:
        found = sorted((p for p in Path(root).rglob(".gitignore") if p.is_file()), key=lambda p: (len(p.parts), p))
        below = [(f"{p.parent.relative_to(root).as_posix()}/".removeprefix("./"), x) for p in found for x in p.read_text().splitlines()]
    lines = [*(("", x) for x in ALWAYS), *(below if ignore is None else (("", x) for x in ignore))]
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(LANGUAGES))
    inner = F.regexp_replace("path", "^.*?" + re.escape(root.strip("/")) + "/", "")
    source = F.col("content").cast("string")
    return df.where(wanted & ~ignored(inner, lines)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), (F.length(source) - F.length(F.replace(source, F.lit("\n"), F.lit("")))).alias("line_count"), source.alias("source"))
