"""Main text of web pages: a recurrent labeller reads the blocks of a page in both directions and keeps those of the article.

A page is cut into blocks at block-level tags and line breaks. Each block becomes a vector of its hashed tag path and attribute
words, hashed words, and figures that relate it to its element, its container and the page. A bidirectional LSTM in numpy
reads the whole sequence, so a teaser that looks like a paragraph is known by its surroundings, whatever the class names.

The model is trained here, on at most SAMPLE pages whose article is known from the stored contents (a documented bound that
holds at every size); a block counts as article text if it is a line of the stored content and not one of the lines that stand
on pages of several articles, whole or with another beginning (an outlet's name, a year). Training takes a fixed number of steps.

Defined results: null and empty pages, and pages without article text, have no paragraphs; markup that is not well-formed is
read as browsers do (missing end tags are implied, unknown ones ignored); a text of any length is one block if nothing splits
it; repeated pages give the same paragraphs; an empty training sample keeps nothing; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bounded_sample, spread
from . import textkit as K

SAMPLE, STEPS, BATCH, HIDDEN, SPAN = 2000, 500, 32, 24, 4096
#: the longest page and content of the sample, contents a name in it; pages on which a line stands (whole, or by its end, if short) that is a notice
LONGEST, CONTENTS, OFTEN, TAILS, TAIL, SHORT, LONG = 200_000, 4, 4, 6, 40, 150, 130
BLOCK_TAGS = frozenset(
    """address article aside blockquote body br button center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul""".split()
)
SKIPPED = frozenset("script style title head template svg math iframe object textarea".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: an opening tag closes an open one of these
IMPLIED = {"p": ("p",), "li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}
CLOSES_P = BLOCK_TAGS - {"br", "button", "html", "body", "noscript", "td", "th", "tr", "li", "option"}
PATHS, ATTRS, WORDS, FIGURES = 32, 32, 96, 24
WIDTH = PATHS + ATTRS + WORDS + FIGURES

_SPLIT = re.compile(r"(<[!/?a-zA-Z][^>]*>)", re.S)
#: what is cut out before the page is split at tags
_HIDDEN = re.compile(r"<!--|<(script|style|template|textarea)\b[^>]*>", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "template", "textarea")}
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*["']?([^"'>]*)""")
_WORD = re.compile(r"[a-z]+")
_tags: dict[str, tuple] = {}


def visible(page: str) -> str:
    """The page up to its last tag without comments and raw elements, and the text after it. Ends that are missing once are not
    looked for again and tags end before the cut, so the time is linear, whatever is left unclosed."""
    last = page.rfind(">") + 1
    out, at, start, missing = [], 0, 0, set()
    while m := _HIDDEN.search(page, start, last):
        name = (m[1] or "").lower()
        end = -1
        if name not in missing:
            if name:
                closing = _ENDS[name].search(page, m.end(), last)
                end = closing.end() if closing else -1
            else:
                found = page.find("-->", m.end(), last)
                end = found + 3 if found >= 0 else -1
            if end < 0:
                missing.add(name)
        if end < 0:
            start = m.end()
            continue
        out.append(page[at : m.start()])
        at = start = end
    return "".join([*out, page[at:]])


def pieces(page: str) -> list[str]:
    """The page cut at tags: text at even places, tags at odd ones."""
    clean = visible(page)
    last = clean.rfind(">") + 1
    got = _SPLIT.split(clean[:last])
    got[-1] += clean[last:]
    return got


def _bucket(text: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % n


def _tag(raw: str) -> tuple:
    """(closing, name, attribute words, raw attributes) of a tag; names of blocks, skipped elements and links matter only."""
    got = _tags.get(raw)
    if got is None:
        if len(_tags) > 100_000:
            _tags.clear()
        m = _TAG.match(raw)
        if m is None:
            got = (False, "", (), "")
        else:
            attr = " ".join(_ATTR.findall(m[3]))
            got = (m[1] == "/", m[2].lower(), tuple(_WORD.findall(re.sub(r"\b[a-z]\d+\b", "coded", attr.lower()))), attr)
        _tags[raw] = got
    return got


class Block:
    __slots__ = ("text", "linked", "path", "words", "element", "parent", "look", "depth")

    def __init__(self, text, linked, path, words, element, parent, look, depth):
        self.text, self.linked, self.path, self.words, self.element, self.parent, self.look, self.depth = text, linked, path, words, element, parent, look, depth


def blocks(page: str) -> tuple[list[Block], str]:
    """The blocks of a page in order, and its title."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, str, int]] = [("", (), "", 0)]  # name, attribute words, raw attributes, serial
    text: list[str] = []
    linked = link = serial = 0
    skip, title = "", ""

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            text.clear()
            if "&" in raw:
                raw = htmllib.unescape(raw)
            clean = " ".join(raw.split())
            if clean:
                top = stack[-1]
                names = tuple(x[0] for x in stack[-3:])
                words = tuple(w for x in stack[-3:] for w in x[1])
                out.append(Block(clean, min(1.0, linked / len(clean)), names, words, top[3], stack[-2][3] if len(stack) > 1 else 0, (top[0], top[2]), len(stack)))
            linked = 0

    for n, part in enumerate(pieces(page)):
        if not part:
            continue
        if not n & 1:
            if not skip:
                text.append(part)
                if link:
                    linked += len(part)
            elif skip == "title":
                title += part
            continue
        closing, name, words, attr = _tag(part)
        if skip:
            if closing and (name == skip or (skip == "head" and name == "title")):
                skip = ""
            elif skip == "head" and name == "title":
                skip = "title"
            elif skip == "head" and name == "body":
                skip = ""
            if skip or name != "body":
                continue
        if name in SKIPPED:
            if not closing and not part.endswith("/>"):
                if name != "head":
                    skip = name
        elif name == "a":
            link = 0 if closing else 1
        elif name in BLOCK_TAGS:
            flush()
            link = 0 if name != "br" else link
            if name in VOID:
                continue
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] in ("table", "article", "main", "body") and name in ("p", "li", "td", "tr"):
                        break
            else:
                gone = IMPLIED.get(name, ("p",) if name in CLOSES_P else ())
                while len(stack) > 1 and stack[-1][0] in gone:
                    stack.pop()
                serial += 1
                stack.append((name, words, attr, serial))
    flush()
    return out, htmllib.unescape(title)


def squeezed(text: str) -> str:
    """Lower case, letters and digits only."""
    low = text.lower()
    return low if low.isalnum() and low.isascii() else "".join(filter(str.isalnum, low))


def para_key(text: str) -> str:
    return hashlib.md5(squeezed(text).encode("utf-8", "surrogatepass")).hexdigest()


def vectors(pages: list[list[Block]], titles: list[str]) -> np.ndarray:
    """(all blocks, WIDTH) features, float32."""
    flat = [b for p in pages for b in p]
    n = len(flat)
    x = np.zeros((n, WIDTH), dtype=np.float32)
    if not n:
        return x
    texts = [b.text for b in flat]
    h, _, _, first = K.words(texts)
    count = np.diff(first)
    for lo in range(0, n, 16 * SPAN):
        hi = min(n, lo + 16 * SPAN)
        owner = np.repeat(np.arange(hi - lo), count[lo:hi])
        col = (h[first[lo] : first[hi]] % K.U64(WORDS)).astype(np.int64)
        bag = np.bincount(owner * WORDS + col, minlength=(hi - lo) * WORDS).reshape(hi - lo, WORDS)
        x[lo:hi, PATHS + ATTRS : PATHS + ATTRS + WORDS] = np.minimum(bag, 3) / np.sqrt(np.maximum(count[lo:hi], 1))[:, None]
    size = np.array([len(t) for t in texts], dtype=np.float64)
    linked = np.array([b.linked for b in flat])
    last = [t[-1] for t in texts]
    ends = np.array([c in ".!?»”\"’)" for c in last], dtype=float)
    cut = np.array([t.endswith(("…", "...")) for t in texts], dtype=float)
    looks: dict = {}
    paths: dict = {}
    page_of = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    look = np.empty(n, dtype=np.int64)
    parent = np.empty(n, dtype=np.int64)
    element = np.empty(n, dtype=np.int64)
    rows, cols = [], []
    for i, b in enumerate(flat):
        key = (b.path, b.words)
        hot = paths.get(key)
        if hot is None:
            own = [_bucket("/".join(b.path[-k:]), PATHS) for k in (1, 2, 3)]
            hot = paths[key] = own + [PATHS + _bucket(w, ATTRS) for w in b.words]
        rows += [i] * len(hot)
        cols += hot
        p = int(page_of[i])
        look[i] = looks.setdefault((p, b.look), len(looks))
        parent[i] = p * 100_003 + b.parent
        element[i] = p * 100_003 + b.element
    x[rows, cols] = 1
    _, parent = np.unique(parent, return_inverse=True)
    total = np.bincount(page_of, weights=size)[page_of]
    by_look, by_parent = np.bincount(look, weights=size), np.bincount(parent, weights=size)
    in_parent = np.bincount(parent)
    weak = np.bincount(parent, weights=((cut > 0) | (linked > 0.5)).astype(float)) / in_parent
    start = np.zeros(len(pages) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in pages], out=start[1:])
    length = np.diff(start)[page_of]
    place = np.arange(n) - start[page_of]
    before = np.arange(n) - 1
    before[place == 0] = np.arange(n)[place == 0]
    heads = [set(t.lower().split()) for t in titles]
    words = [set(t.lower().split()) for t in texts]
    like = np.array([len(w & heads[p]) / len(w) if w and len(w) < 30 else 0.0 for w, p in zip(words, page_of)])
    top = np.maximum.reduceat(by_parent[parent], start[:-1][length_nonzero(pages)])[_dense(pages)] if n else 0
    share = by_parent[parent] / np.maximum(total, 1)
    figures = [
        np.log1p(size) / 6, np.log1p(count) / 4, linked, ends, cut, np.array(["|" in t for t in texts]), np.array(["©" in t for t in texts]),
        np.array([b.depth for b in flat]) / 8, place / np.maximum(length, 1), (parent != parent[before]) | (place == 0), (element == element[np.array(before)]) & (place > 0),
        (look == look[before]) & (place > 0), by_look[look] / np.maximum(total, 1), share, share >= top / np.maximum(total, 1), np.log1p(in_parent[parent]) / 3,
        np.log1p(by_parent[parent] / in_parent[parent]) / 6, weak[parent], like, np.log1p(length) / 4, np.array([t[0].isupper() for t in texts]),
        np.array([t.count(",") for t in texts]) / np.maximum(count, 1), (count < 5), np.ones(n),
    ]
    x[:, PATHS + ATTRS + WORDS :] = np.stack([np.asarray(f, dtype=np.float32) for f in figures], axis=1)
    return x


def length_nonzero(pages: list[list[Block]]) -> np.ndarray:
    return np.flatnonzero([len(p) > 0 for p in pages])


def _dense(pages: list[list[Block]]) -> np.ndarray:
    """Of each block: the rank of its page among the pages with blocks."""
    lengths = np.array([len(p) for p in pages if p])
    return np.repeat(np.arange(len(lengths)), lengths)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (r.standard_normal((width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
            self.p["h" + d] = (r.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * hidden, dtype=np.float32)
            self.p["c" + d][hidden : 2 * hidden] = 1
        self.p["o"] = (r.standard_normal((2 * hidden,)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["ob"] = np.full(1, -1, dtype=np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """Outputs of one direction; with keep also what back-propagation needs. Gates are made for SPAN steps at a time."""
        steps, size, width = x.shape
        n = self.hidden
        h, c = np.zeros((size, n), dtype=np.float32), np.zeros((size, n), dtype=np.float32)
        out, kept = np.zeros((steps, size, n), dtype=np.float32), []
        spans = [(lo, min(lo + SPAN, steps)) for lo in range(0, steps, SPAN)]
        for lo, hi in spans if d == "f" else reversed(spans):
            gates = (x[lo:hi].reshape(-1, width) @ self.p["x" + d] + self.p["c" + d]).reshape(hi - lo, size, 4 * n)
            for t in range(lo, hi) if d == "f" else range(hi - 1, lo - 1, -1):
                g = gates[t - lo] + h @ self.p["h" + d]
                s = _sigmoid(g[:, : 3 * n])
                i, f, o, u = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 3 * n :])
                m = mask[t][:, None]
                c2 = f * c + i * u
                tc = np.tanh(c2)
                if keep:
                    kept.append((t, h, c, i, f, o, u, tc, m))
                h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
                out[t] = h
        return out, kept

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        a, b = self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]
        n = self.hidden
        return _sigmoid(a @ self.p["o"][:n] + b @ self.p["o"][n:] + self.p["ob"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, grads = self.hidden, {}
        (a, ka), (b, kb) = self._run(x, mask, "f"), self._run(x, mask, "b")
        both = np.concatenate([a, b], axis=2)
        delta = ((_sigmoid(both @ self.p["o"] + self.p["ob"]) - y) * mask / max(1.0, mask.sum())).astype(np.float32)
        grads["o"], grads["ob"] = np.einsum("tb,tbh->h", delta, both), delta.sum(keepdims=True).reshape(1)
        back = delta[:, :, None] * self.p["o"]
        for d, kept, dout in (("f", ka, back[:, :, :n]), ("b", kb, back[:, :, n:])):
            dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
            dg_all, dw = np.zeros((*x.shape[:2], 4 * n), dtype=np.float32), np.zeros_like(self.p["h" + d])
            for t, h0, c0, i, f, o, u, tc, m in reversed(kept):
                dh = dh + dout[t]
                hm = dh * m
                do, dc2 = hm * tc, dc * m + hm * o * (1 - tc * tc)
                dg = np.concatenate([dc2 * u * i * (1 - i), dc2 * c0 * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - u * u)], axis=1)
                dg_all[t] = dg
                dw += h0.T @ dg
                dh, dc = dh * (1 - m) + dg @ self.p["h" + d].T, dc * (1 - m) + dc2 * f
            flat = dg_all.reshape(-1, 4 * n)
            grads |= {"x" + d: x.reshape(-1, x.shape[2]).T @ flat, "h" + d: dw, "c" + d: flat.sum(axis=0)}
        return grads

    def train(self, sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 11) -> None:
        """`steps` Adam steps on batches of pages; the rate falls to nothing."""
        r = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for s in range(1, steps + 1):
            pick = r.integers(0, len(sequences), batch)
            x, mask = padded([sequences[i] for i in pick])
            y = np.zeros(mask.shape, dtype=np.float32)
            for j, i in enumerate(pick):
                y[: len(labels[i]), j] = labels[i]
            g = self.gradients(x, mask, y)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * (1 - s / (steps + 1))
            for k in self.p:
                v = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] -= (now * first[k] / (1 - 0.9**s) / (np.sqrt(second[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(s) for s in sequences)
    x = np.zeros((steps, len(sequences), sequences[0].shape[1]), dtype=np.float32)
    mask = np.zeros((steps, len(sequences)), dtype=np.float32)
    for j, s in enumerate(sequences):
        x[: len(s), j], mask[: len(s), j] = s, 1
    return x, mask


def training_pages(pages: DataFrame, page_id: Column, page: Column, name: Column, items: DataFrame, item_name: Column, content: Column, failed: Column, sample: int = SAMPLE) -> list[tuple[str, list[str], bool]]:
    """At most `sample` (page, contents stored under its name, whether it failed), spread by the hash of the page's id.

    Only the sample's names are looked up in the items; at most CONTENTS of a name are taken. Nothing longer than LONGEST is."""
    usable = pages.where(name.isNotNull() | F.coalesce(failed, F.lit(False)))
    p = bounded_sample(usable, page_id, sample).select("__k", page.alias("page"), name.alias("name"), F.coalesce(failed, F.lit(False)).alias("failed"))
    got = sorted(p.where(F.length("page") <= LONGEST).collect(), key=lambda r: r["__k"])
    names = sorted({r.name for r in got if r.name is not None})
    known: dict[str, list[str]] = defaultdict(list)
    if names:
        wanted = pages.sparkSession.createDataFrame([(x,) for x in names], "name string")
        i = items.select(item_name.alias("name"), content.alias("content")).where(f"length(content) <= {LONGEST}").join(F.broadcast(wanted), "name", "left_semi")
        order = Window.partitionBy("name").orderBy(F.xxhash64("content"), "content")  # cut at four before the shuffle too
        for r in i.withColumn("r", F.row_number().over(order)).where(f"r <= {CONTENTS}").collect():
            known[r.name].append(r.content)
    return [(r.page, known.get(r.name, []), r.failed) for r in got]


def fit(sample: list[tuple[str, list[str], bool]]) -> Labeller:
    """A labeller trained on pages whose stored contents show what their article is."""
    parsed = []
    for page, contents, failed in sample:
        b, title = blocks(page)
        keys = [squeezed(x.text) for x in b]
        lines = [{k for line in c.split("\n") if (k := squeezed(line))} for c in contents]
        parsed.append((b, title, keys, lines, failed))
    seen = Counter(k for _, _, keys, _, _ in parsed for k in set(keys))
    tails = Counter(t for _, _, keys, _, _ in parsed for t in {k[-TAIL:] for k in keys})
    notice = lambda k: seen[k] >= OFTEN or len(k) <= SHORT and tails[k[-TAIL:]] >= TAILS
    xs, ys = [], []
    for b, title, keys, lines, failed in parsed:
        if not b:
            continue
        have = set(keys)
        best = max(lines, key=lambda s: len(s & have) / max(1, len(s)), default=set())
        own = {k for k in best if not notice(k)}
        if not failed and len(own & have) < 0.9 * max(1, len(own)):
            continue  # another text was stored under the name, or it was edited
        if any(seen[k] >= OFTEN and len(k) > LONG for k in best):
            continue  # an article that stands on many pages: its lines can't be told from notices
        xs.append(vectors([b], [title]))
        ys.append(np.array([not failed and k in own for k in keys], dtype=np.float32))
    model = Labeller()
    if xs:
        model.train(xs, ys)
    else:
        model.p["o"][:], model.p["ob"][:] = 0, -9
    return model


def label_blocks(model: Labeller, pages: list[str]) -> list[list[tuple[str, float]]]:
    """Of each page its blocks with the probability of being article text; pages of like length share a batch."""
    parsed = [blocks(p) for p in pages]
    x = vectors([b for b, _ in parsed], [t for _, t in parsed])
    start = np.zeros(len(parsed) + 1, dtype=np.int64)
    np.cumsum([len(b) for b, _ in parsed], out=start[1:])
    out: list[list] = [[] for _ in pages]
    order = [i for i in np.argsort(np.diff(start), kind="stable") if len(parsed[i][0])]
    group: list[int] = []
    for n, i in enumerate(order):
        group.append(int(i))
        cells = len(group) * len(parsed[i][0])
        if cells > 20_000 or n == len(order) - 1:
            p = model.predict(*padded([x[start[j] : start[j + 1]] for j in group]))
            for k, j in enumerate(group):
                out[j] = [(b.text, float(v)) for b, v in zip(parsed[j][0], p[:, k])]
            group = []
    return out


def main_text(df: DataFrame, page_id: Column, page: Column, model: Labeller) -> DataFrame:
    """(id, position, text, probability): the blocks of each page's article, in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, pages in K.chunks(*K.columns(batch, "id", "page"), 1 << 19):
                out: list[tuple] = []
                for i, labelled in zip(ids, label_blocks(model, pages)):
                    out += [(i, n, t, p) for n, (t, p) in enumerate(labelled) if p >= 0.5]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.float64()))], names=["id", "position", "text", "probability"])

    d = df.select(page_id.cast("bigint").alias("id"), page.alias("page")).where("id is not null and page is not null")
    return spread(d).mapInArrow(rows, "id bigint, position int, text string, probability double")


def paragraph_keys(df: DataFrame, page_id: Column, page: Column, model: Labeller) -> DataFrame:
    """(id, para_key): as main_text, each paragraph of a page once, by its key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, pages in K.chunks(*K.columns(batch, "id", "page"), 1 << 19):
                out = {(i, para_key(t)): None for i, labelled in zip(ids, label_blocks(model, pages)) for t, p in labelled if p >= 0.5 and squeezed(t)}
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string()))], names=["id", "para_key"])

    d = df.select(page_id.cast("bigint").alias("id"), page.alias("page")).where("id is not null and page is not null")
    return spread(d).mapInArrow(rows, "id bigint, para_key string")


def _line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(squeezed(text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def line_counts(df: DataFrame, page_id: Column, page: Column, model: Labeller, name: Column | None = None) -> DataFrame:
    """(name, key, article, pages): per name of pages and hash of a block, the pages it stands on and those on which it is article text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = K.columns(batch, "page", "name")
            for places, pages in K.chunks(list(range(len(texts))), texts, 1 << 19):
                article: Counter[tuple] = Counter()
                count: Counter[tuple] = Counter()
                for i, labelled in zip(places, label_blocks(model, pages)):
                    own = {_line_hash(t): p >= 0.5 for t, p in sorted(labelled, key=lambda x: x[1])}
                    count.update((names[i], k) for k in own)
                    article.update((names[i], k) for k, a in own.items() if a)
                if count:
                    got = [(n, k, article[n, k], c) for (n, k), c in count.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["name", "key", "article", "pages"])

    named = F.lit(None) if name is None else name
    d = df.select(page_id.cast("bigint").alias("id"), page.alias("page"), named.cast("string").alias("name")).where("id is not null and page is not null")
    return spread(d).mapInArrow(rows, "name string, key bigint, article bigint, pages bigint").groupBy("name", "key").agg(F.sum("article").alias("article"), F.sum("pages").alias("pages"))


def furniture(counts: DataFrame, least_pages: int = 1) -> DataFrame:
    """(key): hashes of blocks that stand on at least `least_pages` pages and are article text on less than half of them."""
    k = counts.groupBy("key").agg(F.sum("article").alias("article"), F.sum("pages").alias("pages"))
    return k.where((2 * F.col("article") < F.col("pages")) & (F.col("pages") >= least_pages)).select("key")


def notices(df: DataFrame, page_id: Column, page: Column, model: Labeller, least_pages: int = 3) -> DataFrame:
    """(key): hashes of blocks that stand on at least `least_pages` pages and are article text on less than half of them."""
    return furniture(line_counts(df, page_id, page, model), least_pages)


def own_exceptions(counts: DataFrame, keys: DataFrame, many: int = 3) -> DataFrame:
    """(name, key, furniture): blocks of the pages of a name that are, on these pages, something else than `keys` says of all pages.

    What is furniture on most of `many` pages or more stays so: one page read wrongly weighs less than the others."""
    own = counts.where("name is not null").select("name", "key", (2 * F.col("article") < F.col("pages")).alias("furniture"))
    other = own.join(keys.withColumn("common", F.lit(True)), "key", "left").where("furniture != (common is not null)")
    return other.join(furniture(counts, many), "key", "left_anti").select("name", "key", "furniture")


def leftovers(items: DataFrame, item_id: Column, content: Column, notice_keys: DataFrame, name: Column | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """(id, line, text): lines of stored contents that are page furniture; line counts from 0.

    A line that stands on a page stored under the item's own name is judged by it (exceptions), any other by all pages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, n, line, _line_hash(line), own) for i, t, own in zip(*K.columns(batch, "id", "t", "name")) for n, line in enumerate(t.split("\n")) if squeezed(line)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()))], names=["id", "line", "text", "key", "name"])

    named = F.lit(None) if name is None else name
    d = items.select(item_id.cast("bigint").alias("id"), content.alias("t"), named.cast("string").alias("name")).where("id is not null and t is not null")
    lines = d.mapInArrow(rows, "id bigint, line int, text string, key bigint, name string")
    if exceptions is None:
        return lines.join(notice_keys, "key", "left_semi").select("id", "line", "text")
    judged = lines.join(notice_keys.withColumn("common", F.lit(True)), "key", "left").join(exceptions, ["key", "name"], "left")
    return judged.where("coalesce(furniture, common, false)").select("id", "line", "text")
