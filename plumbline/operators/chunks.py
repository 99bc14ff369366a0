"""Chunks of texts to be indexed: windows of prose, and the declarations of Java sources.

A source gives one chunk for the head of each type (its signature and fields, no bodies) and one for each method and
constructor, in the order of the source; nested types follow their place, with `$` in their symbols. The scan keeps a
stack of the scopes that are open and reads declarations only: bodies are skipped by their brackets, and comments and
literals are blanked first. A source whose brackets don't match is broken and gives one row that says so.
"""

from __future__ import annotations

import re
import textwrap
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPE, METHOD, BROKEN = "CLASS", "METHOD", "BROKEN"
WINDOW, OVERLAP = 400, 100
LITERALS = re.compile(r'("""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|//[^\n]*|/\*.*?\*/)', re.S)
ANNOTATION = re.compile(r"@(?!interface\b)[\w.]+\s*(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?")
HEAD = re.compile(r"((?:\b(?:public|protected|private|abstract|static|final|sealed|non-sealed|strictfp)\s+)*)(@interface|\bclass|\binterface|\benum|\brecord)\s+(\w+)")
NAMED = re.compile(r"(\w+)\s*\(")
PACKAGE = re.compile(r"\bpackage\s+([\w.]+)\s*;")
PAIRS = {")": "(", "]": "[", "}": "{"}


class Broken(ValueError):
    pass


# Brackets with all that is in them, to a depth; whatever is deeper is counted out bracket by bracket. Nothing is scanned twice: the quantifiers are possessive.
DEPTH = 5
PLAIN, QUIET = r"[^()\[\]{}]*+", r"[^;()\[\]{}]*+"
INSIDE = PLAIN
for _ in range(DEPTH - 1):
    INSIDE = rf"{PLAIN}(?:(?:\({INSIDE}\)|\{{{INSIDE}\}}|\[{INSIDE}\]){PLAIN})*+"
#: What stands before the first brace outside of parentheses or the semicolon, and the brackets of that brace; and all up to the next semicolon.
DECLARATION = re.compile(rf"{QUIET}(?:(?:\({INSIDE}\)|\[{INSIDE}\]){QUIET})*+(?:;|(\{{){INSIDE}\}})")
REST = re.compile(rf"{QUIET}(?:(?:\({INSIDE}\)|\{{{INSIDE}\}}|\[{INSIDE}\]){QUIET})*+;")
BRACKET, SIGN, CLOSER, PARENTHESES, LINE = re.compile(r"[()\[\]{}]"), re.compile(r"[;({\[]"), re.compile(r"[)}\]]"), re.compile(r"\([^()]*\)"), re.compile("\n")
NO_LINE, BLANK = re.compile(r"[^\n]"), re.compile(r"\n[ \t]+(?:\n|\Z)")
TYPES = re.compile("class|interface|enum|record")
#: Heads are kept up to this length, since they recur.
SHORT, HEADS = 200, 4096


def blanked(source: str) -> str:
    """The source with spaces for comments and literals, as long as before and with the same lines."""
    parts = LITERALS.split(source)
    parts[1::2] = [NO_LINE.sub(" ", x) if "\n" in x else " " * len(x) for x in parts[1::2]]
    return "".join(parts)


def _closed(code: str, at: int) -> int:
    """The place of the bracket that closes the one at a place."""
    open_ = []
    for m in BRACKET.finditer(code, at):
        if m[0] in PAIRS:
            if not open_ or open_.pop() != PAIRS[m[0]]:
                raise Broken
            if not open_:
                return m.start()
        else:
            open_.append(m[0])
    raise Broken


def _valued(head: str) -> bool:
    """Whether an initial value goes before the brace that follows."""
    return "=" in head and "=" in PARENTHESES.sub("", ANNOTATION.sub("", head))


def _statements(code: str, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, the first brace outside of parentheses or -1, end) of the declarations between two places.

    A declaration ends at a semicolon, or at the brace that closes its body unless it has an initial value."""
    while m := DECLARATION.match(code, at, end):
        brace, close = m.start(1), m.end()
        if brace >= 0 and _valued(code[at:brace]):
            if not (m := REST.match(code, close, end)):
                break
            close = m.end()
        yield at, brace, close
        at = close
    # What is nested deeper, or has a bracket too many; at last only what is left behind the declarations.
    start, m = at, SIGN.search(code, at, end)
    brace = -1
    while m:
        if m[0] == ";":
            yield start, brace, m.end()
            start, brace, at = m.end(), -1, m.end()
        else:
            at = _closed(code, m.start()) + 1
            if at > end:
                raise Broken
            if m[0] == "{":
                brace = m.start() if brace < 0 else brace
                if not _valued(code[start:brace]):
                    yield start, brace, at
                    start, brace = at, -1
        m = SIGN.search(code, at, end)
    if (left := code[start:end]).strip() and CLOSER.search(left):
        raise Broken


def _head(head: str) -> tuple[str | None, bool, bool, str | None, str, str, str, str]:
    """Of what stands before a body: the name before its parentheses, whether it has a value and any text, its type's kind, name and skeleton, its last word."""
    head = ANNOTATION.sub("", head) if "@" in head else head
    name = NAMED.search(head) if "(" in head else None
    valued = "=" in (head[: name.start()] if name else head)
    type_ = HEAD.search(head) if not valued and TYPES.search(head) else None
    kind = type_[2] if type_ and not (name and name.start() < type_.start()) else None
    skeleton = f"{' '.join([*type_[1].split(), type_[2], type_[3]])} {{\n" if kind else ""
    return name[1] if name else None, valued, bool(head.strip(" \t\r\n;")), kind, type_[3] if kind else "", skeleton, "".join(head.split()[-1:])


_recurring = lru_cache(HEADS)(_head)


def _dedented(text: str, margin: str) -> str:
    """textwrap.dedent and strip of a text whose first line is indented by a margin."""
    if "\n" not in text:
        return text.strip()
    if not BLANK.search(text):
        if not margin:
            return text.strip()
        if text.count("\n" + margin) == text.count("\n"):
            return text.replace("\n" + margin, "\n").strip()
    return textwrap.dedent(text).strip()


def java_chunks(source: str, contents: bool = True) -> list[tuple[str, str, int, int, str | None]]:
    """(symbol, kind, first line, last line, content) of a source's chunks, in order; contents are null if nobody asks for them."""
    code = blanked(source)
    package = PACKAGE.search(code)
    out: list[tuple[str, str, int, int, str]] = []
    fields: dict[int, list[str]] = {}
    ends = [m.start() for m in LINE.finditer(source)]

    def text(start: int, end: int) -> str:
        lead = source[source.rfind("\n", 0, start) + 1 : start]
        return _dedented(lead + source[start:end], lead) if not lead.strip(" \t") else textwrap.dedent((lead if not lead.strip() else "") + source[start:end]).strip()

    # Scopes that are open: the symbol of their type and its name, their kind, the declarations that they still have, and their place.
    scopes = [(package[1] + "." if package else "", "", "", _statements(code, 0, len(code)), -1)]
    while scopes:
        symbol, own, kind, left, place = scopes[-1]
        for start, brace, end in left:
            start = end - len(code[start:end].lstrip())
            head = code[start : brace if brace >= 0 else end]
            called, valued, any_, inner, type_, skeleton, last = (_recurring if len(head) <= SHORT else _head)(head)
            if inner and brace >= 0:
                body = brace + 1
                if inner == "enum":  # the constants come first
                    body = _constants(code, body, end - 1)
                fields[len(out)] = [skeleton]
                inside = f"{symbol}${type_}" if place >= 0 else symbol + type_
                scopes.append((inside, inside.rpartition("$")[2].rpartition(".")[2], inner, _statements(code, body, end - 1), len(out)))
                out.append((inside, TYPE, bisect_left(ends, start) + 1, bisect_left(ends, end - 1) + 1, ""))
                break
            if place < 0 or kind == "@interface":
                continue  # imports, and members of annotations
            if called and not valued or (kind == "record" and brace >= 0 and last == own):
                out.append((f"{symbol}#{'<init>' if (called or own) == own else called}", METHOD, bisect_left(ends, start) + 1, bisect_left(ends, end - 1) + 1, text(start, end) if contents else None))
            elif contents and code[end - 1] == ";" and any_:
                fields[place].append(textwrap.indent(text(start, end), "    ") + "\n")
        else:
            scopes.pop()
    for place, parts in fields.items():
        out[place] = *out[place][:4], "".join(parts) + "}" if contents else None
    return out


def _constants(code: str, at: int, end: int) -> int:
    """Where the constants of an enum end: behind the first semicolon outside of brackets, or with the enum."""
    if m := REST.match(code, at, end):
        return m.end()
    m = SIGN.search(code, at, end)
    while m:
        if m[0] == ";":
            return m.end()
        m = SIGN.search(code, _closed(code, m.start()) + 1, end)
    return end


FOUND = {"n int": pa.int32(), "symbol string": pa.string(), "kind string": pa.string(), "start_line int": pa.int32(), "end_line int": pa.int32(), "content string": pa.string()}
#: Chunks and characters of sources that a task holds before it hands them on.
CHUNKS, CHARACTERS = 20_000, 4_000_000


def _split(contents: bool):
    def batch(paths: pa.Array, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kinds = list(FOUND.values())[: None if contents else -1]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([paths.take(pa.array(of, pa.int32())), *columns], names=["path", *[x.split()[0] for x in FOUND][: len(kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: list[int] = []
            rows: list[tuple] = []
            size = 0
            for i, source in enumerate(b.column(1)):
                source = source.as_py() or ""
                try:
                    found = java_chunks(source, contents)
                except Broken:
                    found = [(None, BROKEN, None, None, None)]
                of.extend([i] * len(found))
                rows.extend([(n, *row) for n, row in enumerate(found)])
                size += len(source)
                if rows and (len(rows) >= CHUNKS or size >= CHARACTERS):
                    yield batch(b.column(0), of, rows)
                    of, rows, size = [], [], 0
            if rows:
                yield batch(b.column(0), of, rows)

    return run


def structural(files: DataFrame, path: str = "path", content: str = "content", contents: bool = True) -> DataFrame:
    """(path, n, symbol, kind, start_line, end_line, content) of the chunks of Java files; n counts a file's chunks from 0.

    Without contents that column is left out, and nothing is cut out of the sources for it."""
    rows = files.select(F.col(path).alias("path"), F.col(content).alias("source"))
    return rows.mapInArrow(_split(contents), ", ".join([f"path {rows.schema['path'].dataType.simpleString()}", *list(FOUND)[: None if contents else -1]]))


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, start, content): windows of `size` code points that share `overlap` with the next, of whole texts.

    A window begins every size - overlap; the last one reaches the end. Null and empty texts have none. A text is cut
    into steps once, so its time grows with its length."""
    step = size - overlap
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    more = -(-overlap // step)
    own = docs.where(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), steps.alias("steps"))
    count = F.greatest(F.lit(1), F.size("steps") - F.when(F.length(F.element_at("steps", -1)) <= overlap, more).otherwise(0))
    placed = own.select("doc_id", "steps", F.explode(F.sequence(F.lit(1), count)).alias("k"))
    content = F.substring(F.array_join(F.slice("steps", F.col("k"), F.lit(1 + more)), ""), 1, size)
    return placed.select("doc_id", (F.col("k") - 1).cast("long").alias("chunk"), ((F.col("k") - 1) * step).cast("long").alias("start"), content.alias("content"))
