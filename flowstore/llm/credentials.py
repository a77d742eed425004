"""Credentials in source code and configuration files: found, confirmed over the corpus, redacted.

A file's lines are read for literals in the places where credentials stand. All of them
are indexed over the corpus with the number of their owners: what many owners share, in
lines that differ, is a stand-in; what few have, or only copies of a line, and is built
like a credential is confirmed. Every file is then
scanned again for the confirmed values, wherever they stand.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.plans.tables import cut

#: A value that more owners have than this, and in more lines that differ, is a stand-in.
MAX_OWNERS = 12
#: Bits of the filter of confirmed values' words that is broadcast, of this size at any number of values.
FILTER = 1 << 24
#: A shorter value is sought elsewhere only if it looks like one without a name, and between blanks or quotes.
SURE_LENGTH = 12
MARK = "REDACTED"

_PLAIN = {"password", "passwd", "pass", "pwd", "secret", "token", "passphrase", "credential", "credentials", "apikey", "authtoken", "authorization", "passwort", "pat"}
_KEYED = {"api", "signing", "secret", "private", "access", "encryption", "auth", "client", "master", "session", "account", "ssh", "deploy", "service", "license", "shared", "hmac", "jwt", "aes"}
_TAIL = re.compile(r"^(?:v|\d+|old|new|prod|dev|staging|test|prev|previous|value|string|b64|base64|hex|enc|encoded)$", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def names_credential(name: str) -> bool:
    """Whether what stands under the name grants access, to judge by the name's last words; plurals, types, files, hashes and the like do not."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and _TAIL.match(words[-1]):
        words.pop()
    if not words:
        return False
    if words[-1] in _PLAIN:
        return words[:-1][-1:] not in (["csrf"], ["public"], ["next"], ["page"])
    return words[-1] == "key" and len(words) > 1 and words[-2] in _KEYED


_MASK = re.compile(r"^(?:[*xX•.·#?_-]+|\W+)$")
_STANDIN = re.compile(
    r"redacted|change[_-]?me|changeit|replace[_-]?(?:with|me|this)|placeholder|example|dummy|sample|your[_-]|[_-]here$|^todo|^tbd|^fixme|insert[_-]|^none$|^null$|^nil$|^true$|^false$|^undefined$|not[_-]?set|^unset|^empty|^hidden$|^masked$|^secret$|^password$|^token$|to[_-]be[_-]|fill[_-]?(?:in|me)|goes[_-]here",
    re.I,
)
_REFERENCE = re.compile(
    r"^(?:\$|%[\w.-]+%|\{\{|\{%|<|\[|@|!|&|\.{1,2}/|[a-z]:\\)|^~?(?-i:(?:/[a-z0-9_.-]*)+$)|^(?:env|vault|file|secret|secrets|ref|arn|ssm|awssm|gcpsm|op|keyring|keychain|k8s|azurekeyvault|sm|sops|doppler|param|config)(?::|\.)|^[a-z][\w+.-]*://|^process\.env|^os\.|\$\{|\{\{|^%\(|^(?:sha\d+|md5|bcrypt|argon2\w*|pbkdf2\w*):|^\$(?:2[aby]|argon2|6|5|1)\$|^\w+\(",
    re.I,
)
_KNOWN = re.compile(
    r"(?:(?=[\w.-]*[A-Z])(?=[\w.-]*\d)(?:[a-z]{2,6}-(?:[a-z]{2,6}-)?|[a-z]{2,6}_(?:[a-z]{2,5}_)?|[a-z]{2,3}\.)[A-Za-z0-9_-]{20,}|AIza[\w-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|SG\.[\w-]{16,}\.[\w-]{16,})(?![\w.])"
)
#: Such a value without any name, between delimiters
_ALONE = re.compile(r"""(?<=[\s"'`(=:,>])""" + _KNOWN.pattern)
_WRITTEN = re.compile(r"^[\x21-\x7e]+$")


def _decoded(value: str) -> str | None:
    """What a base64 text says, if it says something printable."""
    if len(value) < 8 or len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", value):
        return None
    try:
        text = base64.b64decode(value.replace("-", "+").replace("_", "/"), validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError):
        return None
    return text if text and all(" " <= c <= "~" for c in text) else None


def stands_in(value: str) -> bool:
    """Empty or masked values, stand-ins and references, also in base64."""
    v = value.strip()
    if len(v) < 4 or _MASK.match(v) or _STANDIN.search(v) and not _KNOWN.fullmatch(v) or _REFERENCE.search(v):
        return True
    inner = _decoded(v)
    return bool(inner) and (bool(_MASK.match(inner)) or bool(_STANDIN.search(inner)) or bool(_REFERENCE.search(inner)))


def structured(value: str, strict: bool = False) -> bool:
    """Built like a credential: a known format, or no blank and mixed characters. strict is for values without a name of their own."""
    v = value.strip()
    if _KNOWN.fullmatch(v):
        return True
    if not _WRITTEN.match(v):
        return False
    kinds = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if strict:
        return len(v) >= 8 and bool(re.search(r"\d", v)) and kinds >= 2 and not re.fullmatch(r"[a-z]+[_.-]?\d+|v?\d+(?:\.\d+)+\w*|[\d.,:-]+|[a-z]+(?:[_.-][a-z0-9]+)+", v)
    return len(v) >= 6 and kinds >= 2 and not re.fullmatch(r"[\d.,:-]{1,9}", v)


_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What follows the header of a key without an end
_PEM_BODY = re.compile(r"""(?:(?:\\[nr]|[\s"'`+,])*[A-Za-z0-9+/=]{16,})*""")
_QUOTED = r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)"""
_QUOTE = re.compile(_QUOTED)
#: name = "literal", name: 'literal', {"name": "literal"}, name := `literal`, name=("literal"
_ASSIGNED = re.compile(r"""(["'`]?)([A-Za-z_][\w.-]*)\1\]?[ \t]*(?::=|=>|[:=])[ \t]*(?:[brfu]{0,2}\(?[ \t]*)""" + _QUOTED)
#: getenv("NAME", "literal") and the like
_DEFAULT = re.compile(r"""(?:getenv|environ\.get|env|get_env|GetEnv\w*|getOrDefault|get)\(\s*["']([\w.-]+)["']\s*,\s*""" + _QUOTED)
_ELSE = re.compile(r"""\$\{([A-Za-z_]\w*):?-([^}$\s]+)\}""")
#: a whole line of an assignment without quotes, also commented out or in a list
_BARE = re.compile(r"""^[ \t]*(?:(?:#|//|;|--)[ \t]*)?(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+|ENV[ \t]+|const[ \t]+|var[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*(?:=|:)[ \t]*([^\s"'`][^\r\n]*?)[ \t]*(?:[ \t]#[^\r\n]*)?\r?$""")
_BLOCK = re.compile(r"""^([ \t]*)(?:-[ \t]+)?(["']?)([A-Za-z_][\w.-]*)\2[ \t]*:[ \t]*[|>][+-]?\d*[ \t]*\r?$""")
_HEADER = re.compile(r"""\b(?:Bearer|Basic|Token)[ \t]+([^\s"'`,;]+)""")
_URL = re.compile(r"""[a-z][a-z0-9+.-]*://([^\s/:@"'`<>]*):([^\s/@"'`]+)@""", re.I)
_FLAG = re.compile(r"""(?<![\w-])--?([A-Za-z][\w-]*)(?:=|[ \t]+)(?:""" + _QUOTED + r"""|([^\s"'`-][^\s"'`]*))""")
_USERPASS = re.compile(r"""(?<![\w-])(?:-u|--user)[ \t=]+["']?[\w.@-]+:([^\s"'`]+)""")
#: Passwords in sentences and comments: the words, then within a few words the value, mostly in quotes or at the end
_PROSE = re.compile(
    r"""\b((?:[A-Za-z]+[ _-])?(?:password|passwd|passphrase|secret|token|(?:api|access|signing|private|secret)[ _-]?key|credential|credentials|pass|pwd))\b(?:[ \t]+(?:for|of|on|in|to|at)[ \t]+[\w.-]+(?:[ \t]+[\w.-]+)?)?[ \t]*(?:[:=]|\bis\b|\bwas\b|\bto\b|->)?[ \t]*(?:["'`]([^"'`\s]+)["'`]|([^\s"'`]+))""",
    re.I,
)
#: A line without any of these names no credential
_HINT = re.compile(r"(?i:pass|pwd|secret|token|credential|authorization|key)|pat(?![a-z])|Pat(?![a-z])|PAT(?![A-Z])")
#: Every known format has so long a run
_LONG = re.compile(r"[\w-]{16}|eyJ[\w-]{8}")
_CODE = {"go", "py", "js", "ts", "java", "rb", "rs", "c", "cpp", "cs", "php", "kt", "scala"}

Hit = tuple[int, list[tuple[int, int]], str, bool]  # offset, spans of the value's parts, value, whether it has a name of its own


def literals(text: str, path: str | None = None) -> list[Hit]:
    """Values in the places where credentials stand, each with the spans of its parts."""
    ext = (path or "").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    code = ext in _CODE
    out: list[Hit] = []
    taken: list[tuple[int, int]] = []

    def add(spans: list[tuple[int, int]], named: bool) -> None:
        spans = [s for s in spans if s[0] < s[1]]
        if not spans or any(a < spans[0][1] and spans[0][0] < b for a, b in taken):
            return
        taken.extend(spans)
        out.append((spans[0][0], spans, "".join(text[a:b] for a, b in spans), named))

    for m in _PEM.finditer(text):
        end = _PEM_END.search(text, m.end())
        body = (m.end(), end.start() if end else _PEM_BODY.match(text, m.end()).end())
        if len(re.sub(r"\\[nr]|\s", "", text[slice(*body)])) >= 40:
            taken.append(body)
            out.append((m.start(), [body], m.group(), True))
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1

    def group(m: re.Match, first: int) -> tuple[int, int]:
        k = next(k for k in range(first, first + 3) if m.group(k) is not None)
        return m.span(k)

    for no, (start, line) in enumerate(lines):
        if len(line) < 6:
            continue
        move = lambda s: (start + s[0], start + s[1])  # noqa: B023, E731
        named = bool(_HINT.search(line))
        for m in _ASSIGNED.finditer(line) if named else ():
            # quoted values of names, with the literals that continue them on this line or the next ones
            if not names_credential(m.group(2)):
                continue
            spans, end = [move(group(m, 3))], start + m.end()
            while code and (more := re.compile(r"[ \t]*(?:\+|\.|\\)?[ \t]*\r?\n?[ \t]*(?:\+[ \t]*)?" + _QUOTED).match(text, end)) and not more.group().lstrip().startswith("\n\n"):
                if not re.match(r"[ \t]*(?:\+|\.|\\|\r?\n)", more.group()) or ("+" not in more.group() and "(" not in m.group()):
                    break
                spans.append(group(more, 1))
                end = more.end()
            value = "".join(text[a:b] for a, b in spans)
            if re.match(r"(?:Bearer|Basic|Token)[ \t]", value):
                continue
            add(spans, True)
        for m in _DEFAULT.finditer(line) if named else ():
            if names_credential(m.group(1)):
                add([move(group(m, 2))], True)
        for m in _ELSE.finditer(line) if named else ():
            if names_credential(m.group(1)):
                add([move(m.span(2))], True)
        for m in _HEADER.finditer(line):
            add([move(m.span(1))], True)
        for m in _URL.finditer(line):
            add([move(m.span(2))], True)
        for m in _USERPASS.finditer(line):
            add([move(m.span(1))], True)
        alone = [move(m.span()) for m in _ALONE.finditer(line)] if _LONG.search(line) else []
        if named and (m := _BLOCK.match(line)):
            if names_credential(m.group(3)):
                spans = []
                for s, below in lines[no + 1 :]:
                    if below.strip() and len(below) - len(below.lstrip()) <= len(m.group(1)):
                        break
                    body = below.strip()
                    if body:
                        spans.append((s + below.index(body[0]), s + below.index(body[0]) + len(body)))
                if spans and not text[spans[0][0] :].startswith("-----BEGIN"):
                    add(spans, True)
        if named and (not code or re.match(r"[ \t]*(?:#|//)", line)):
            m = _BARE.match(line)
            if m and names_credential(m.group(1)) and not (ext == "json" and re.match(r"[\[{]", m.group(2))):
                value = m.group(2)
                if " " not in value and not (code and re.search(r"[()\[\]]", value)):
                    add([move(m.span(2))], True)
        for m in _FLAG.finditer(line) if named else ():
            if names_credential(m.group(1)) and (ext in ("sh", "bash", "md", "yml", "yaml", "txt", "dockerfile", "makefile") or m.group(0).startswith("--")):
                add([move(m.span(5) if m.group(5) is not None else group(m, 2))], True)
        if named and (ext in ("md", "txt", "rst") or re.search(r"(?:^|\s)(?:#|//|;|--|/\*|\*)", line)):
            for m in _PROSE.finditer(line):
                span = m.span(2) if m.group(2) is not None else m.span(3)
                while span[1] > span[0] and m.group(2) is None and line[span[1] - 1] in ".,;)":
                    span = (span[0], span[1] - 1)
                add([move(span)], False)
        for span in alone:
            add([span], True)
    return out


def accept(value: str, named: bool) -> bool:
    """Whether a literal is built like a credential and is no stand-in; a PEM header stands for its key."""
    return bool(_PEM.match(value)) or (not stands_in(value) and structured(value, strict=not named))


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with every span replaced: the first part of a value by a mark without any character that needs quoting, further parts of it by nothing.

    A value in base64 of something printable is replaced by a mark in base64, so that it
    can still be decoded. Line ends inside a private key stay.
    """
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        old = text[a:b]
        if "\n" in old or "\\n" in old:
            new = re.sub(r"(?:(?!\\n|\\r)[^\s\\])+", MARK, old)
        else:
            new = base64.b64encode(MARK.encode()).decode() if _decoded(old) else MARK
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def _context(text: str, offset: int, value: str) -> int:
    """A hash of the line around a value."""
    start = text.rfind("\n", 0, offset) + 1
    end = text.find("\n", offset)
    return xxhash.xxh64_intdigest(text[start : len(text) if end < 0 else end].replace(value, "").strip()) >> 1


def _line(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for key, owner, path, text in zip(df["key"], df["owner"], df["path"], df["text"]):
            for offset, spans, value, named in literals(text, path):
                rows.append((key, owner, _line(text, offset), offset, value, named, _context(text, offset, value), [[int(a), int(b)] for a, b in spans]))
        yield pd.DataFrame(rows, columns=["key", "owner", "line_no", "offset", "value", "named", "context", "spans"])


_RUN = re.compile(r"[A-Za-z0-9]+")


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def anchor(value: str) -> int | None:
    """The hash of the longest run of letters and digits of a value, the first of equals: wherever the
    value stands between other characters, this is a whole word of the text.
    """
    longest = max(_RUN.findall(value), key=len, default=None)
    return None if longest is None else word_hash(longest)


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each value that the corpus leaves: whether it is confirmed, and the word by which it is sought elsewhere (null: nowhere)."""
    for df in batches:
        fit = [accept(v, bool(n)) for v, n in zip(df["value"], df["named"])]
        seek = [f and not v.startswith("-----BEGIN") and (len(v) >= SURE_LENGTH or structured(v, strict=True)) for f, v in zip(fit, df["value"])]
        yield pd.DataFrame({"value": df["value"], "named": df["named"], "fit": fit, "word": pd.array([anchor(v) if s else None for s, v in zip(seek, df["value"])], dtype="Int64")})


def _hits(words: dict[int, int]):
    """(a, b, word): the hashes of the words of each text, named by two hashes, that the filter lets pass."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = words.value
        for df in batches:
            rows = []
            for a, b, text in zip(df["a"], df["b"], df["text"]):
                for h in {word_hash(w) for w in set(_RUN.findall(text))}:
                    at = h % FILTER
                    if own.get(at >> 6, 0) >> (at & 63) & 1:
                        rows.append((a, b, h))
            yield pd.DataFrame(rows, columns=["a", "b", "word"])

    return step


def _rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the values that a text may have stand in it; one automaton for all values of a batch."""
    import ahocorasick

    near = re.compile(r"[A-Za-z0-9]")
    for df in batches:
        trie, rows = ahocorasick.Automaton(), []
        for v in {v for values in df["values"] for v in values}:
            trie.add_word(v, len(v))
        trie.make_automaton()
        for key, text in zip(df["key"], df["text"]):
            keys = [(m.start(), (_PEM_END.search(text, m.end()) or m).end()) for m in _PEM.finditer(text)]
            for end, size in trie.iter(text):
                a, b = end + 1 - size, end + 1
                before, after = text[a - 1 : a], text[b : b + 1]
                edges = not (near.match(before) or near.match(after)) if size >= SURE_LENGTH else not (before.strip("\"'` \t\r\n") or after.strip("\"'` \t\r\n"))
                if edges and not any(s <= a < e for s, e in keys):
                    rows.append((key, _line(text, a), a, [[a, b]]))
        yield pd.DataFrame(rows, columns=["key", "line_no", "offset", "spans"])


def find_credentials(files: DataFrame, key: str, owner: str, path: str, text: str, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(key, line_no, offset, spans) of every credential: the line (from 1, ended by LF) and character where it starts, and the spans of its parts.

    Null and empty texts have none; a null owner counts as one owner, a null path as a file
    of no known kind; repeated rows and keys give one row for each offset; an empty table none. Other
    columns are ignored, whatever their names.

    Literals are read file by file, of any length, and indexed whatever they look like.
    Owners are counted by value with a combine before the shuffle, so that a stand-in in a
    third of all files costs no task more; what many share is dropped. What is left is
    confirmed once for each value by how it is built. Confirmed values are then sought in
    all texts: a filter of fixed size, made of a word of each value, tells the texts that
    may have some; a join on the words gives each such text its values, and an automaton
    of the values of a batch finds where they stand. No values come to the driver.
    """
    whole = files.select(F.col(f"`{key}`").alias("key"), F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{text}`").cast("string").alias("text"))
    whole = whole.where("text is not null and length(text) > 0")
    kind = dict(whole.dtypes)["key"]
    seen = cut(whole.mapInPandas(_extract, f"key {kind}, owner string, line_no int, offset int, value string, named boolean, context long, spans array<array<int>>"))
    values = corpus_values(seen, max_owners)
    good = seen.join(values.where("fit").select("value", "named"), ["value", "named"]).select("key", "line_no", "offset", "spans")
    sought = values.where("word is not null").select("word", "value").distinct()
    place = F.pmod("word", F.lit(FILTER))
    bits = sought.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(word, {FILTER}) & 63 as int))")).alias("b"))
    # at most FILTER / 64 rows
    words = files.sparkSession.sparkContext.broadcast({int(r.w): int(r.b) & (1 << 64) - 1 for r in bits.collect()})
    # equal texts have equal values, so that keys need not be unique or known
    texts = whole.select("key", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    having = texts.select("a", "b", "text").mapInPandas(_hits(words), "a long, b long, word long").distinct().join(sought, "word")
    having = having.groupBy("a", "b").agg(F.collect_set("value").alias("values"))
    again = texts.join(having, ["a", "b"]).select("key", "text", "values").mapInPandas(_rescan, f"key {kind}, line_no int, offset int, spans array<array<int>>")
    return good.unionByName(again).dropDuplicates(["key", "offset"])


def corpus_values(seen: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(value, named, fit, word) of each literal that not more than max_owners owners, or lines, share; fit if it is built like a credential."""
    owners = seen.groupBy("value").agg(F.count_distinct(F.coalesce("owner", F.lit(""))).alias("owners"), F.count_distinct("context").alias("lines"), F.collect_set("named").alias("kinds"))
    rare = owners.where((F.col("owners") <= max_owners) | (F.col("lines") <= max_owners) | F.col("value").startswith("-----BEGIN"))
    return cut(rare.select("value", F.explode("kinds").alias("named")).mapInPandas(_confirm, "value string, named boolean, fit boolean, word long"))


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame({"key": df["key"], "text": [t if s is None or not len(s) else redacted(t, [(int(a), int(b)) for one in s for a, b in one]) for t, s in zip(df["text"], df["spans"])], "n_redacted": [0 if s is None else len(s) for s in df["spans"]]})


def redact_credentials(files: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n_redacted) of every file, with what `find_credentials` found replaced; keys must be unique. Null and empty texts stay as they are."""
    spans = found.groupBy("key").agg(F.collect_list("spans").alias("spans"))
    whole = files.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(spans, "key", "left")
    return whole.mapInPandas(_redact, f"key {dict(whole.dtypes)['key']}, text string, n_redacted int")
