"""Template residue, filler and error pages, found by positive-unlabelled naive Bayes.

A text is read in passages: its sentences and lines, without fenced code, and with quoted
words and inline code reduced to marks, as what is quoted is not shown in place of
content. Passages that fit one of a few trusted forms are the positive records, all
others are unlabelled. Expectation maximisation lets the unlabelled ones share between
the two classes; the model then scores every passage of every record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.plans.tables import cut

#: Records that fit the model, about (a hash sample); how much likelier a record with a trusted passage is taken; width of the hashed features; rounds.
SAMPLE, BOOST, WIDTH, ROUNDS = 8_000, 10, 1 << 18, 3
#: Share of passages expected to be residue before one is seen, weight of the background in the smoothing, log odds from which a passage is residue.
PRIOR, SMOOTH, LEAST = 0.02, 3.0, 0.0
#: Share of the trusted passages that are less common than those taken for surely ordinary.
SPY = 0.9
#: Effective independence of a passage's features: their log odds are damped by length ** -DAMP.
DAMP = 0.35

#: Texts scored at once; tasks that read the texts of the sample
TOGETHER, FIT_TASKS = 1000, 16

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*\r?$|\Z)", re.S | re.M)
_CODE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"(?<!\w)[\"“„«][^\"”“»\n]{2,200}[\"”“»](?!\w)")
_QUOTES, _ENDS = re.compile("[\"“„«]"), re.compile(r"[\r\n]+")
_STARTS = re.compile(r"^[ \t]*(?:[-*+][ \t]+|#{1,6}[ \t]+|>[ \t]*|v\d+(?:\.\d+)+[ \t]+|(?:tool|user|assistant|system|q|a)[ \t]*:[ \t]+)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[ \t]+(?=\S)")

_NAME = r"[A-Za-zÀ-ÿ][\w .-]{0,40}?"
#: Placeholders of template languages and of people, each with a mark and texts of which it has one
PLACEHOLDERS = tuple(
    (mark, needs, re.compile(form))
    for mark, needs, form in (
        ("curly", ("{{",), rf"\{{\{{[-~#.$]?\s*{_NAME}\s*[-~]?\}}\}}"),
        ("dollar", ("${", "#{"), r"[$#]\{\w[\w. ]*\}"),
        ("statement", ("{%", "<%"), rf"\{{%-?\s*{_NAME}\s*-?%\}}|<%[=-]?\s*{_NAME}\s*%>"),
        ("percent", ("%",), r"%\([A-Za-z]\w*\)[sd]|(?<![\w%])%[A-Za-z]\w{1,40}%(?!\w)"),
        ("angles", ("<<", "«"), rf"<<\s*{_NAME}\s*>>|«\s*{_NAME}\s*»"),
        ("brackets", ("[[",), rf"\[\[\s*{_NAME}\s*\]\]"),
        ("at", ("@@",), r"@@\w[\w ]*@@"),
        ("under", ("__",), r"(?<!\w)__[A-Za-z]\w*?__(?!\w)"),
        ("dollars", ("$",), r"(?<![\w$])\$[A-Za-z]\w{1,40}\$(?!\w)"),
        ("single", ("{",), r"(?<![{$#%\w\"'\]:])\{[A-Za-z]\w{1,40}\}(?![}\w])"),
        ("upper", ("<",), r"<[A-Z][A-Z_]{2,40}>"),
        ("asked", ("<", "[", "("), r"(?i:[<\[(](?:your|insert|enter|add|put|fill(?: in)?|type|votre|ihr[e]?|su|tu|à compléter|a completar|completar|einfügen|hier|bitte|insérer|insertar)\b[^\n<>\[\]()]{1,50}[>\])]|[<\[(][^\n<>\[\]()]{1,40} (?:goes here|here|ici|aquí|einfügen|einsetzen|eintragen)[>\])])"),
        ("object", ("[object", "<no "), r"\[object Object\]|<no value>"),
    )
)
#: A line with these words is filler throughout
FILLER = re.compile(r"\blorem ipsum\b", re.I)
#: Forms whose passages are trusted to be residue, whatever the place: how a passage begins, what it has anywhere
TRUSTED = tuple(
    (opens and re.compile(opens, re.I), inside and re.compile(inside, re.I))
    for opens, inside in (
        (None, FILLER.pattern),
        (r"(?:dummy|sample|placeholder|example|filler) (?:text|entry|content|page)\b|this is (?:a )?(?:sample|dummy|placeholder|filler)|(?:your \w+ will appear|content coming soon|\w+ goes here)|replace this (?:paragraph|text)|page intentionally left", None),
        (r"(?:dies ist ein )?(?:blind|beispiel|platzhalter|füll)text\b|inhalt folgt|hier entsteht|(?:du )?(?:faux texte|texte (?:provisoire|de remplissage|d'exemple))|remplacez ce|contenu à venir|(?:este es un )?texto (?:de (?:relleno|ejemplo|muestra|prueba)|provisional)|(?:sustituya|reemplace|cambie) este|contenido próximamente|próximamente", r"durch eigenen text ersetzen"),
        (r"(?:<noscript>)?\W*(?:please |bitte |veuillez |por favor,? )?(?:enable|activate|turn on|aktivieren|activer|active) (?:sie )?(?:js|javascript|scripts|cookies)\b|(?:<noscript>)?\W*(?:javascript|scripts?) (?:is|are|must|ist|sind) (?:required|disabled|be enabled)|checking your browser", r"<noscript>"),
        (r"(?:diese|esta|cette|this) (?:anwendung|seite|aplicación|página|application|page|app|site) (?:benötigt|necesita|requiere|nécessite|requires|needs) javascript|(?:in ihrem browser|los scripts|les scripts|your browser)\b.{0,60}(?:ausgeschaltet|deaktiviert|desactivados|bloqueados|bloqués|désactivés|switched off|not support)", None),
        (r"(?:https?[ /]?[\d.]*[ ]?)?(?:error|status|fehler|erreur|error http|http status|http error|code)?\W*[45]\d\d\s*(?:[-–—:|]\s*\w|[A-ZÀ-Ý])[^.]{2,60}\.?$", r"\((?:code|error|http|fehler|erreur|código) [45]\d\d\)"),
        (r"\{\s*\"error\"\s*:|<error>|<\?xml[^>]*><error>|(?:fatal )?error\b.{0,30}\b[45]\d\d\b|upstream connect (?:error|failure)", None),
        (r"panic: |goroutine \d+ \[|traceback \(most recent call last\)|exception in thread|unhandled (?:exception|promise)|\s*at [\w.$]+\([\w.]+:\d+\)", None),
        (r"(?:internal server error|service unavailable|bad gateway|gateway time-?out|page not found|access denied|forbidden|unauthorized|not found|too many requests|something went wrong)\b[^.]{0,20}\W*$", None),
        (r"[\w ]{2,30} (?:is )?temporarily (?:not available|unavailable)|[\w ]{2,30} vorübergehend nicht (?:erreichbar|verfügbar)|[\w ]{2,30} momentanément indisponible|[\w ]{2,30} no disponible temporalmente|an unexpected (?:condition|error)|our engineers (?:were|have been) (?:told|notified)", None),
    )
)
#: Any of them at once, and any text that a placeholder needs
_OPENS = re.compile("|".join(f"(?:{o.pattern})" for o, _ in TRUSTED if o), re.I)
_INSIDE = re.compile("|".join(f"(?:{i.pattern})" for _, i in TRUSTED if i), re.I)
_NEEDS = re.compile("|".join(re.escape(x) for x in sorted({x for _, needs, _ in PLACEHOLDERS for x in needs})))

_IDENT = re.compile(r"\b[a-z]+(?:[_.-](?:[a-z]+|\d+))+\b", re.I)
_HEX = re.compile(r"\b0x[0-9a-f]+\b|\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{6,}\b", re.I)


def sure_passages(text: str) -> set[str]:
    """The trusted passages of a text, with all that a line says beside the words of filler text."""
    out = set()
    for line in re.split(r"[\r\n]+", text):
        filler = FILLER.search(line)
        out.update(p for p in passages(line) if filler or trusted(p))
    return out


def passages(text: str) -> list[str]:
    """The sentences and lines of a text outside of fenced code, with inline code and quotations as the marks ⟦code⟧ and ⟦quote⟧."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    out = []
    for line in _ENDS.split(text):
        bare = line.strip()
        if not bare:
            continue
        whole = bare[0] in "{<[" and bare[-1] in "}>]"  # a line of JSON or markup is one passage
        if "`" in line:
            line = _CODE.sub(" ⟦code⟧ ", line)
        if not whole and _QUOTES.search(line):
            line = _QUOTED.sub(" ⟦quote⟧ ", line)
        line = _STARTS.sub("", line).strip()
        out += [p.strip() for p in ([line] if whole else _SENTENCE.split(line)) if p.strip()]
    return out


def placeholder_marks(passage: str) -> list[str]:
    if not _NEEDS.search(passage):
        return []
    return [mark for mark, needs, form in PLACEHOLDERS if any(x in passage for x in needs) and form.search(passage)]


def trusted_forms(passage: str) -> list[int]:
    """The trusted forms that a passage has."""
    if not _OPENS.match(passage):
        low = passage.lower()
        if not ("(" in low or "lorem" in low or "durch" in low or "<nosc" in low) or not _INSIDE.search(passage):
            return []
    return [k for k, (opens, inside) in enumerate(TRUSTED) if (opens and opens.match(passage)) or (inside and inside.search(passage))]


def trusted(passage: str) -> bool:
    """Whether a passage has one of the trusted forms or an unfilled placeholder."""
    return bool(trusted_forms(passage)) or bool(placeholder_marks(passage))


#: Parts of words: their ends and beginnings, which foreign and invented words share
_PARTS = (("e", -2, None), ("f", -3, None), ("b", 0, 3))
_WORD = re.compile(r"[^\W\d_]+|\d+|⟦\w+⟧|[^\w\s]")
_DIGIT = re.compile(r"\d")
_HELD = {f"⟦{mark}⟧" for mark, _, _ in PLACEHOLDERS}


def _hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word)


def _word_features(word: str) -> tuple[int, int, int, int, int, bool]:
    """Of a distinct word: its number in pairs, the features of itself, of its ends and beginning (-1 for none), and whether it is the mark of a placeholder."""
    if word.isdigit():
        word = "⟦status⟧" if len(word) == 3 and word[0] in "45" else "⟦n⟧"
    parts = [_hash(f"{k}:{word[a:b]}") % WIDTH for k, a, b in _PARTS] if len(word) > 3 and word[0] != "⟦" else [-1, -1, -1]
    return _hash(word), _hash(f"w:{word}") % WIDTH, *parts, word in _HELD


def features(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(passage, feature) of each distinct hashed feature of each passage, in order.

    Features are words, pairs of words, word ends and beginnings, and the trusted forms a
    passage has; of a passage with placeholders only these and what is beside them. Words
    are hashed once each, all else is arithmetic on arrays.
    """
    flat: list[str] = []
    sizes, marked, owners, extra = [], [], [], []
    for i, passage in enumerate(many):
        known, marks = [f"t:{k}" for k in trusted_forms(passage)], []
        if _NEEDS.search(passage):
            for mark, needs, form in PLACEHOLDERS:
                if any(x in passage for x in needs):
                    passage, n = form.subn(f" ⟦{mark}⟧ ", passage)
                    if n:
                        marks.append(f"m:{mark}")
        if "_" in passage or "-" in passage or "." in passage[:-1]:
            passage = _IDENT.sub(" ⟦name⟧ ", passage)
        if _DIGIT.search(passage):
            passage = _HEX.sub(" ⟦hex⟧ ", passage)
        words = ["^", *_WORD.findall(passage.lower()), "$"]
        flat += words
        sizes.append(len(words))
        marked.append(bool(marks))
        more = [*known, *marks, *(["m:any"] if marks else []), *(["t:any"] if known or marks else [])]
        owners += [i] * len(more)
        extra += more
    if not many:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code, distinct = pd.factorize(np.array(flat, dtype=object))
    table = np.array([_word_features(w) for w in distinct], np.int64)
    owner, own = np.repeat(np.arange(len(many)), sizes), table[code]
    plain = ~np.array(marked)[owner]
    ends = np.cumsum(sizes)
    middle = np.ones(len(code), bool)
    middle[ends - 1] = middle[ends - np.array(sizes)] = False
    pair = np.ones(len(code), bool)
    pair[ends - 1] = False
    left = np.flatnonzero(pair)
    left = left[plain[left] | (own[left, 5] == 1) | (own[left + 1, 5] == 1)]
    mixed = (own[left, 0].astype(np.uint64) * np.uint64(0x9E3779B1) + own[left + 1, 0].astype(np.uint64)) * np.uint64(0x85EBCA77C2B2AE63)
    rows = [(owner[left], (mixed >> np.uint64(40)).astype(np.int64) % WIDTH)]
    for column in range(1, 5):
        at = np.flatnonzero(middle & plain & (own[:, column] >= 0))
        rows.append((owner[at], own[at, column]))
    rows.append((np.array(owners, np.int64), np.array([_hash(f) % WIDTH for f in extra], np.int64)))
    key = np.sort(np.concatenate([o * WIDTH + f for o, f in rows]))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key // WIDTH, key % WIDTH


class Model:
    """Weights of the hashed features and a bias; the score of a passage is its damped log odds of being residue."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, many: list[str]) -> np.ndarray:
        owner, flat = features(many)
        size = np.maximum(np.bincount(owner, minlength=len(many)), 1)
        return self.bias + np.bincount(owner, self.weights[flat], len(many)) * size.astype(float) ** -DAMP


def described(texts: list[str]) -> tuple[list[bytes], list[int], list[bool]]:
    """The distinct sets of features of the passages of texts, how many texts' passages each stands for,
    and whether one of these is trusted. Passages are counted once a text.
    """
    times_of: dict[str, int] = {}
    known: set[str] = set()
    for t in texts:
        own = set(passages(t))
        for p in own:
            times_of[p] = times_of.get(p, 0) + 1
        if any(trusted(p) for p in own):
            known |= own & sure_passages(_FENCE.sub("\n", t))
    count: dict[bytes, int] = {}
    sure: dict[bytes, bool] = {}
    every = list(times_of)
    for s in range(0, len(every), 20_000):
        part = every[s : s + 20_000]
        owner, flat = features(part)
        for p, f in zip(part, np.split(flat.astype(np.int32), np.searchsorted(owner, np.arange(1, len(part))))):
            k = f.tobytes()
            count[k] = count.get(k, 0) + times_of[p]
            sure[k] = sure.get(k, False) or p in known
    return list(count), list(count.values()), [sure[k] for k in count]


def fit(keys: list[bytes], counts: list[int], sure: list[bool]) -> Model:
    """Naive Bayes on described passages, by expectation maximisation from the trusted ones.

    Trusted passages stay positive; the others start as negative and share in both classes by
    their posterior from then on. The prior stays PRIOR, so that no large group of
    ordinary passages can drift over.
    """
    if not keys:
        return Model(np.zeros(WIDTH, np.float32), float(np.log(PRIOR / (1 - PRIOR))))
    rows = [np.frombuffer(k, np.int32) for k in keys]
    size = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    n = np.sqrt(np.array(counts, float))  # repeats of one sentence are weak evidence
    label = np.array(sure, bool)
    post = label.astype(float)
    bias = float(np.log(PRIOR / (1 - PRIOR)))
    # how common what a passage says is: passages more common than nearly all trusted ones are surely ordinary
    times = np.bincount(flat, np.array(counts, float)[owner], WIDTH)
    common = np.bincount(owner, np.log(times[flat] + 1), len(rows)) / size
    ordinary = ~label & (common > (np.quantile(common[label], SPY) if label.any() else 0))
    for _ in range(ROUNDS):
        yes, no = np.bincount(flat, (post * n)[owner], WIDTH), np.bincount(flat, ((1 - post) * n)[owner], WIDTH)
        back = (yes + no) / n.sum()  # either class is smoothed towards all passages
        back[back == 0] = 1
        yes, no = (yes + SMOOTH * back) / ((post * n).sum() + SMOOTH), (no + SMOOTH * back) / (((1 - post) * n).sum() + SMOOTH)
        weights = np.where(times > 0, np.log(yes / no), 0.0)
        odds = bias + np.bincount(owner, weights[flat], len(rows)) * size.astype(float) ** -DAMP
        post = np.where(label, 1.0, np.where(ordinary, 0.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))))
    return Model(weights.astype(np.float32), bias)


def _pick(rate: float):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            keep = [h < rate or (h < BOOST * rate and any(map(trusted, passages(t)))) for h, t in zip(df["h"], df["text"])]
            yield df.loc[keep, ["h", "text"]]

    return step


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        keys, counts, sure = described(list(df["text"]))
        yield pd.DataFrame({"f": keys, "n": counts, "sure": sure})


def judge(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the highest score of a passage, how many are residue, and how many there are. Passages that texts share are scored once."""
    number: dict[str, int] = {}
    parts = [[number.setdefault(p, len(number)) for p in set(passages(t))] for t in texts]
    size = np.array([len(x) for x in parts], np.int64)
    owner, at = np.repeat(np.arange(len(texts)), size), np.array([i for x in parts for i in x], np.int64)
    score = model.scores(list(number))[at]
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, score)
    return best, np.bincount(owner, score >= LEAST, len(texts)).astype(np.int64), size


def _score(model):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*model.value)
        for df in batches:
            for s in range(0, len(df), TOGETHER):
                part = df.iloc[s : s + TOGETHER]
                best, bad, size = judge(own, list(part["text"]))
                yield pd.DataFrame({"key": part["key"], "score": best, "n_residue": bad, "n_passages": size})

    return step


def score_residue(rows: DataFrame, key: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """(key, score, n_residue, n_passages) of every row with a text that is not blank.

    score is the highest damped log odds of a passage being residue; from LEAST (0) on the
    row is residue, in part or whole. Null and blank texts are left out; a short text is
    judged by what it says; repeated rows and keys come out as often as they go in; an
    empty table gives no rows; other columns are ignored. A text is read whole, in one task.

    The passages of a sample are described and counted by Spark, and the model is fitted to
    the counts on the driver. The sample is a hash sample of about `sample` rows, and
    BOOST times as large a share of those with a trusted passage, copies of a text folded
    and never more than three times `sample` in all, the first by hash; the model that is broadcast has WIDTH weights at any size.
    """
    whole = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("text rlike '\\\\S'")
    kind = dict(whole.dtypes)["key"]
    n = whole.count()
    hashed = whole.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30))
    rate = min(1.0, sample / max(n, 1))
    picked = hashed.where(F.col("h") < min(1.0, BOOST * rate)).mapInPandas(_pick(rate), "h double, text string").distinct().orderBy("h", "text").limit(3 * sample)
    parts = cut(picked.select("text").repartition(FIT_TASKS)).mapInPandas(_describe, "f binary, n long, sure boolean")
    # one row for each set of features of at most 3 * sample texts, in one order
    told = parts.groupBy("f").agg(F.sum("n").alias("n"), F.max("sure").alias("sure")).toPandas()
    order = sorted(range(len(told)), key=lambda i: bytes(told["f"][i]))
    fitted = fit([bytes(told["f"][i]) for i in order], [int(told["n"][i]) for i in order], [bool(told["sure"][i]) for i in order])
    # plain arrays, so that executors need no class of this package
    model = rows.sparkSession.sparkContext.broadcast((fitted.weights, fitted.bias))
    return whole.mapInPandas(_score(model), f"key {kind}, score double, n_residue int, n_passages int")


def without_residue(rows: DataFrame, key: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """The rows without those that show residue, with all their columns; keys must be unique, and rows of a null key stay."""
    bad = score_residue(rows, key, text, sample).where(F.col("score") >= LEAST).select(F.col("key").alias("__bad"))
    return rows.join(bad, F.col(f"`{key}`") == F.col("__bad"), "left_anti")
