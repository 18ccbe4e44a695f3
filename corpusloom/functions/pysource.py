"""Python source to rows: what a parse task does with one file. Everything around it is Spark's."""

from __future__ import annotations

import ast
import codecs
import io
import re
import sys
import tokenize
import traceback
from collections.abc import Iterator
from pathlib import PurePosixPath

from ..model import ALL_FAILED, STUB, STUB_CODE, STUB_COLUMN, STUB_LINE, TOO_DEEP, UNDECODABLE, UNEXPECTED
from .encodings import detect

RECURSION_LIMIT = 3000
INDENT = 4
KEPT, KEPT_LENGTH = 16, 1 << 20  # texts a worker remembers as too deep, and their length at most
_FAILED: dict[str, dict] = {}
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def module_name(path: str) -> str:
    """The file's stem; a package's own file is named after its folder."""
    p = PurePosixPath(path)
    return p.parent.name if p.stem == "__init__" else p.stem


_NONE: list = []  # shared by all rows, which are only read
_BLANK = dict.fromkeys(("name", "element_type", "line_start", "line_end", "module_path", "parent_name", "docstring", "signature", "source_module", "is_from_import"))
_BLANK |= dict.fromkeys(("decorators", "bases", "methods", "attributes", "import_names", "import_aliases", "calls"), _NONE) | {"depth_in_functions": 0, "is_mock": False, "scope": ""}


def _element(**values) -> dict:
    return _BLANK | values


def _pairs(items: dict[str, str | None]) -> list[dict]:
    return [{"key": k, "value": v} for k, v in items.items()]


def _written(node: ast.expr) -> str:
    """``ast.unparse``, which costs much for the names and numbers that most expressions are."""
    if node.__class__ is ast.Name:
        return node.id
    if node.__class__ is ast.Constant and (node.value is None or node.value.__class__ in (bool, int)):
        return repr(node.value)
    return ast.unparse(node)


#: Fields that hold no nodes, or only nodes without a name, a call or a statement.
_PLAIN = frozenset(("ctx", "op", "ops", "names", "id", "attr", "name", "module", "level", "kind", "type_comment", "type_ignores", "simple", "conversion", "rest", "kwd_attrs", "is_async", "arg"))
_INNER: dict[type, tuple[str, ...]] = {}
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _nodes(n: ast.AST) -> list[ast.AST]:
    """The child nodes that can hold names, calls or statements, in source order of fields."""
    kind = n.__class__
    fields = _INNER.get(kind)
    if fields is None:
        fields = _INNER[kind] = () if kind in (ast.Name, ast.Constant) else tuple(f for f in kind._fields if f not in _PLAIN or (f == "arg" and kind is ast.arguments))
    out = []
    for f in fields:
        v = getattr(n, f, None)
        if v.__class__ is list:
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST):
            out.append(v)
    return out


def _check_depth(tree: ast.AST, code: str) -> None:
    """Refuse trees deeper than the limit; a text with fewer characters has none."""
    if len(code) < RECURSION_LIMIT - 100:
        return
    level, n = [tree], 0
    while level:
        n += 1
        if n > RECURSION_LIMIT:
            raise RecursionError("maximum recursion depth exceeded")
        level = [c for x in level for c in _nodes(x)]


def _parameters(args: ast.arguments) -> list[dict]:
    rows = []

    def add(a: ast.arg, default: ast.expr | None = None, keyword=False, positional=False, variadic=False) -> None:
        rows.append({
            "name": a.arg, "type_annotation": _written(a.annotation) if a.annotation else None, "default_value": _written(default) if default is not None else None,
            "is_keyword_only": keyword, "is_positional_only": positional, "is_variadic": variadic, "description": None,
        })

    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + args.defaults
    for k, (a, d) in enumerate(zip(plain, defaults)):
        add(a, d, positional=k < len(args.posonlyargs))
    if args.vararg:
        add(args.vararg, variadic=True)
    for a, d in zip(args.kwonlyargs, args.kw_defaults):
        add(a, d, keyword=True)
    if args.kwarg:
        add(args.kwarg, variadic=True)
    return rows


def _yields(node: ast.AST) -> bool:
    """Whether a function's own body yields; functions inside it don't count."""
    todo = _nodes(node)
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.Yield, ast.YieldFrom)):
            return True
        if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)):
            todo += _nodes(n)
    return False


def _attributes(node: ast.ClassDef) -> dict[str, str | None]:
    found: dict[str, str | None] = {}
    for x in node.body:
        if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
            found[x.target.id] = _written(x.annotation)
        elif isinstance(x, ast.Assign):
            found |= {t.id: found.get(t.id) for t in x.targets if isinstance(t, ast.Name)}
    return found


def _dotted(node: ast.expr) -> str:
    """A called name as written: a name, attributes of it, or of ``super()``; of anything else the attribute only."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return "super()" if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super" else "?"


def _calls(body: list[ast.stmt]) -> list[dict]:
    """The calls that run in a body itself. Of definitions in it only what their heads compute does."""
    found, todo = [], list(reversed(body))
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Call):
            found.append({"name": _dotted(n.func), "line": n.lineno})
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner = [*n.decorator_list, *n.args.defaults, *filter(None, n.args.kw_defaults)]
        elif isinstance(n, ast.ClassDef):
            inner = [*n.decorator_list, *n.bases, *(k.value for k in n.keywords)]
        else:
            inner = _nodes(n)
        todo += reversed(inner)
    return found


def elements_of(tree: ast.Module, path: str, code: str) -> list[dict]:
    """The module, and its imports, classes, methods and functions in source order, nested ones included. Only statements
    hold statements, so the walk keeps to them; a text without the word has no generators."""
    module, lines, yields = module_name(path), len(code.splitlines()), "yield" in code
    _check_depth(tree, code)
    rows = [_element(name=module, element_type="MODULE", line_start=1, line_end=lines, module_path=module, docstring=ast.get_docstring(tree), calls=_calls(tree.body))]

    def walk(node: ast.AST, owner: str | None, depth: int, scope: str) -> None:
        inner = lambda name: f"{scope}.{name}" if scope else name
        for x in (x for f in _BLOCKS for x in getattr(node, f, ())):
            kind = x.__class__
            if kind is ast.Expr or kind is ast.Assign or kind is ast.Pass or kind is ast.Return:
                continue
            at = {"line_start": getattr(x, "lineno", None), "line_end": getattr(x, "end_lineno", None) or -1, "module_path": module, "depth_in_functions": depth, "scope": scope}
            if isinstance(x, ast.Import):
                for a in x.names:
                    rows.append(_element(**at, name=a.name, element_type="IMPORT", parent_name=owner, source_module=a.name, import_names=[a.name], import_aliases=_pairs({a.name: a.asname} if a.asname else {}), is_from_import=False))
            elif isinstance(x, ast.ImportFrom):
                source = "." * x.level + (x.module or "")
                rows.append(_element(**at, name=source, element_type="IMPORT", parent_name=owner, source_module=source, import_names=[a.name for a in x.names], import_aliases=_pairs({a.name: a.asname for a in x.names if a.asname}), is_from_import=True))
            elif isinstance(x, ast.ClassDef):
                methods = list(dict.fromkeys(m.name for m in x.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))))
                rows.append(_element(**at, name=x.name, element_type="CLASS", parent_name=owner, docstring=ast.get_docstring(x), decorators=[_written(d) for d in x.decorator_list], bases=[_written(b) for b in x.bases], methods=methods, attributes=_pairs(_attributes(x)), calls=_calls(x.body)))
                walk(x, x.name, depth, inner(x.name))
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                decorators = [_written(d) for d in x.decorator_list]
                signature = {
                    "parameters": _parameters(x.args), "return_type": _written(x.returns) if x.returns else None, "is_async": isinstance(x, ast.AsyncFunctionDef),
                    "is_generator": yields and _yields(x), "is_abstract": any(d.rpartition(".")[2] == "abstractmethod" for d in decorators),
                }
                rows.append(_element(**at, name=x.name, element_type="METHOD" if owner else "FUNCTION", parent_name=owner, docstring=ast.get_docstring(x), decorators=decorators, signature=signature, calls=_calls(x.body)))
                walk(x, None, depth + 1, f"{inner(x.name)}.<locals>")
            else:
                walk(x, owner, depth, scope)

    walk(tree, None, 0, "")
    return rows


def snippet(code: str, line: int | None) -> str | None:
    """The line at fault and two on either side, numbered; null where no line is known."""
    if not code or line is None:
        return None
    lines = code.splitlines()
    return "\n".join(f"{'>>> ' if n == line else '    '}{n}: {lines[n - 1]}" for n in range(max(1, line - 2), min(len(lines), line + 2) + 1))


class _deep:
    """A recursion limit for the time of a parse."""

    def __enter__(self):
        self.before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(self.before, RECURSION_LIMIT))

    def __exit__(self, *_):
        sys.setrecursionlimit(self.before)


def _tree(code: str, path: str) -> tuple[list[dict], None] | tuple[None, dict]:
    known = _FAILED.get(code)
    if known is not None:
        return None, dict(known)
    error = dict.fromkeys(("error_type", "message", "line", "column", "traceback", "code_snippet"))
    try:
        with _deep():
            tree = ast.parse(code, filename=path)
            return elements_of(tree, path, code), None
    except SyntaxError as e:
        return None, error | {"error_type": "SyntaxError", "message": str(e), "line": e.lineno, "column": e.offset, "code_snippet": snippet(code, e.lineno)}
    except RecursionError as e:
        error |= {"error_type": "RecursionError", "message": f"{TOO_DEEP}{e}"}
    except Exception as e:  # null bytes, memory: whatever one file does must not stop the job
        error |= {"error_type": type(e).__name__, "message": f"{UNEXPECTED}{e}", "traceback": traceback.format_exc()}
    # These errors depend on the text alone, and texts that are too deep take longest: a copy isn't parsed again.
    if len(code) <= KEPT_LENGTH:
        if len(_FAILED) >= KEPT:
            _FAILED.pop(next(iter(_FAILED)))
        _FAILED[code] = error
    return None, dict(error)


def parse_safely(path: str, data: bytes) -> dict:
    """A row of PARSED without fallbacks: elements, or the error."""
    try:
        elements, error = _tree(data.decode("utf-8"), path)
    except UnicodeDecodeError as e:
        elements, error = None, {"error_type": "UnicodeDecodeError", "message": f"{UNDECODABLE}{e}", "line": None, "column": None, "traceback": None, "code_snippet": None}
    return {"file_path": path, "elements": elements, "error": error, "fallback_level": 0 if elements is not None else None, "issues_found": [], "sanitized_lines": 0}


def encodings(data: bytes) -> list[str]:
    """Encodings worth trying for bytes that aren't UTF-8: by byte order mark, by coding comment, by their characters, then
    western ones."""
    marks = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
    found = [name for mark, name in marks if data.startswith(mark)][:1]
    cookie = re.match(rb"(?:[^\n]*\n)?[ \t\f]*#[^\n]*?coding[:=][ \t]*([-\w.]+)", data)
    if cookie:
        try:
            found.append(codecs.lookup(cookie[1].decode()).name)
        except LookupError:
            pass
    return list(dict.fromkeys([*found, detect(data)[0], "cp1252", "latin-1"]))


def sanitize(code: str) -> tuple[str, int, bool]:
    """Source without byte order mark, mixed tabs, control characters and uneven indents; lines changed; whether
    anything was. Line ends stay as they are."""
    text = code.removeprefix("﻿")
    out, changed = [], 0
    for line in text.split("\n"):
        fixed = line.replace("\t", " " * INDENT) if "\t" in line and " " in line.lstrip("\t") else line
        fixed = _CONTROL.sub(" ", fixed)
        changed += fixed != line
        out.append(fixed)
    widths = [len(x) - len(x.lstrip()) if x.strip() else 0 for x in out]
    units = {j for w in widths[1:] for j in range(1, w + 1) if w % j == 0 and w // j <= 10}
    if len(units) > 1:
        unit = min(units)
        even = [" " * (INDENT * (w // unit)) + x[w:] if w else x for x, w in zip(out, widths)]
        changed += sum(a != b for a, b in zip(even, out))
        out = even
    return "\n".join(out), changed, text != code or changed > 0


def _indent(line: str) -> int:
    wide = line.expandtabs(8)
    return len(wide) - len(wide.lstrip())


def salvage(code: str, path: str) -> Iterator[dict]:
    """Placeholders for the functions, classes and methods that the token stream still shows. Where it breaks, or a
    definition starts inside brackets that were never closed, the scan starts again: at that definition, or at the next line
    that is indented no deeper than the broken statement. What a definition belongs to follows from indents alone."""
    module, scopes, lines, at = module_name(path), [], io.StringIO(code).readlines(), 0  # scopes: (indent, kind, name)

    def placeholder(t: tokenize.TokenInfo, line: int, kind: str) -> dict:
        owner = scopes[-1][2] if scopes and scopes[-1][1] == "class" else None
        type_ = "CLASS" if kind == "class" else "METHOD" if owner else "FUNCTION"
        scope = ".".join(name + ".<locals>" * (k == "def") for _, k, name in scopes)
        row = _element(name=t.string, element_type=type_, line_start=line, line_end=line, module_path=module, parent_name=owner, depth_in_functions=sum(k == "def" for _, k, _ in scopes), is_mock=True, scope=scope)
        if type_ != "CLASS":
            own = ast.arguments(posonlyargs=[], args=[ast.arg("self")] * (owner is not None and t.string == "__init__"), kwonlyargs=[], kw_defaults=[], defaults=[])
            row["signature"] = {"parameters": _parameters(own), "return_type": None, "is_async": False, "is_generator": False, "is_abstract": False}
        scopes.append((_indent(lines[line - 1]), kind, t.string))
        return row

    while at < len(lines):
        rest = iter(range(at, len(lines)))
        want, brackets, depth, seen, fresh, again = None, 0, 0, at, True, len(lines)
        try:
            for t in tokenize.generate_tokens(lambda: lines[next(rest)]):
                line = at + t.start[0]
                if t.type in (tokenize.NL, tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT):
                    continue
                if t.type == tokenize.NAME and t.string in ("def", "class") and brackets and line - 1 > at:
                    again = line - 1
                    break
                if fresh and t.type != tokenize.NEWLINE and line <= len(lines):
                    depth = _indent(lines[line - 1])
                    while scopes and scopes[-1][0] >= depth:
                        scopes.pop()
                fresh = t.type == tokenize.NEWLINE
                seen = at + t.end[0]
                if t.type == tokenize.NAME and want:
                    yield placeholder(t, line, want)
                want = t.string if t.type == tokenize.NAME and t.string in ("def", "class") and not want else None
                if t.type == tokenize.OP:
                    brackets = max(0, brackets + (t.string in "([{") - (t.string in ")]}"))
        except IndentationError as e:  # back to a level that a scan from within doesn't know
            again = max(at + 1, at + (e.lineno or 1) - 1)
        except (tokenize.TokenError, SyntaxError):
            again = max(at + 1, seen)
            while again < len(lines) and (not lines[again].strip() or _indent(lines[again]) > depth):
                again += 1
        at = again


def stub(path: str, error: dict) -> dict:
    """A module element that stands for a file which couldn't be parsed, with the error as its docstring."""
    place = "" if not error["line"] else f"{STUB_LINE}{error['line']}" + (f"{STUB_COLUMN}{error['column']}" if error["column"] else "") + "\n"
    code = f"{STUB_CODE}{error['code_snippet']}\n" if error["code_snippet"] else ""
    text = STUB.format(**error) + place + code
    module = module_name(path)
    return _element(name=module, element_type="MODULE", line_start=1, line_end=1, module_path=module, docstring=text, is_mock=True)


def _plain(error: dict) -> str:
    """The message without the place that Python adds to it."""
    return re.sub(r" \([^()]*, line \d+\)$", "", error["message"])


def parse_with_fallbacks(path: str, data: bytes) -> dict:
    """A row of PARSED by the chain: as it is (0), other encodings (1), sanitised (keeps 1, else 2), tokens (3), stub (4)."""
    row = parse_safely(path, data)
    if row["elements"] is not None:
        return row
    error = row["error"]
    undecodable = error["error_type"] == "UnicodeDecodeError"
    level = 1 if undecodable else 2
    issues = [error["message"] if undecodable else f"Syntax error at line {error['line']}: {_plain(error)}" if error["error_type"] == "SyntaxError" else error["message"]]
    codes = [data.decode("utf-8", "replace")] if not undecodable else []
    for name in encodings(data) if undecodable else []:
        try:
            code = data.decode(name)
        except UnicodeError:
            continue
        codes.append(code)
        elements, failed = _tree(code, path)
        if elements is not None:
            return row | {"elements": elements, "fallback_level": level, "issues_found": issues}
        issues.append(f"Failed with encoding {name}: {_plain(failed)}")
    codes = codes or [data.decode("utf-8", "replace")]
    clean, lines, changed = sanitize(codes[0])
    if changed:
        elements, failed = _tree(clean, path)
        if elements is not None:
            return row | {"elements": elements, "fallback_level": level, "issues_found": issues, "sanitized_lines": lines}
        issues.append(f"Failed after sanitization: {_plain(failed)}")
    found = list(salvage(clean, path))
    if found:
        return row | {"elements": found, "fallback_level": 3, "issues_found": issues, "sanitized_lines": lines}
    final = error | {"error_type": "MultipleFallbackFailure", "message": f"{ALL_FAILED}{', '.join(issues)}"}
    return row | {"elements": [stub(path, error)], "error": final, "fallback_level": 4, "issues_found": issues, "sanitized_lines": lines}
