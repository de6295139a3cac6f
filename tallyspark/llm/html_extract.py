"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaves (runs of text between block-level tags).  A leaf has the hashed tags, classes
and ids of its path, its hashed words, and a few figures (length, share of link text, marks, place).  A numpy
bidirectional LSTM reads the whole sequence, so every leaf is judged with the document around it.  It is trained
here, on pages drawn from templates (seeded; regions with their usual tags, class names and words), and sent to the
tasks; pages are labelled in padded batches of like length.

Defined cases: null or empty html gives an empty text; broken or cut-off markup is read as far as it goes; whole
pages are read; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, hashed_words, table

PATH, WORDS, FIGURES = 384, 96, 10
EMBED, HIDDEN = 24, 14
THRESHOLD = 0.5
# Elements of HTML by how they lay out text.
RAW = "script|style|textarea|title|noscript|template|iframe|svg|select|audio|video|canvas|head"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label object math mrow mi mn mo ms mtext mfrac msup msub msqrt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th".split())
# Attributes as far as the tag's end; a quoted value is read whole, and nothing that was read is given back.
_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
# A raw element with its content; svg may be closed in its own tag.
_RAW = rf"<({RAW.replace('|head', '')})(?=[\s/>])(?:(?<=<svg){_REST}(?<=/)>|[^>]*>.*?(?:</\1\s*>|\Z))"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|{_RAW}|<(/?)([a-zA-Z][^\s/>]*)({_REST})>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=1 << 15)
def _step_features(tag: str, names: str) -> tuple[int, ...]:
    """Slots of one step of a path: its tag, the words of its names, and their first four letters."""
    out = {crc32(f"t:{tag}".encode()) % PATH}
    for w in _WORD.findall(names):
        w = w.lower()
        out.add(crc32(f"n:{w}".encode()) % PATH)
        out.add(crc32(f"n:{w[:4]}*".encode()) % PATH)
    return tuple(sorted(out))


def leaves(page: str | None) -> list[tuple[str, tuple, int]]:
    """(text, path, characters inside links) of the runs of text in page order; a path is a tuple of (tag, names)."""
    out: list = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    links = linked = 0

    def flush():
        nonlocal text, linked
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            if t:
                out.append((t, tuple(stack), linked))
        text, linked = [], 0

    page = page or ""
    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m.group(3)
        if tag is None:
            if m.group(1):
                text.append(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if m.group(2) else links + 1
            continue
        if tag == "br" or tag == "img" or tag == "input":
            text.append(" ")
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "menu") or stack[k][0] == "tr" and tag in ("td", "th"):
                    break
                if stack[k][0] == tag or tag in ("dt", "dd") and stack[k][0] in ("dt", "dd") or tag in ("td", "th") and stack[k][0] in ("td", "th"):
                    del stack[k:]
                    break
        stack.append((tag, " ".join(x for g in _NAMES.findall(m.group(4)) for x in g if x)))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def encode(pages: list[list]) -> np.ndarray:
    """Feature rows of all leaves of the pages, in order."""
    flat = [x for p in pages for x in p]
    n = len(flat)
    x = np.zeros((n, PATH + WORDS + FIGURES), np.float32)
    if not n:
        return x
    rows, cols = [], []
    known: dict = {}
    for i, (_, path, _) in enumerate(flat):
        slots = known.get(path)
        if slots is None:
            slots = known[path] = sorted({s for step in path for s in _step_features(*step)})
        rows += [i] * len(slots)
        cols += slots
    x[rows, cols] = 1
    texts = [t.encode("utf-8", "surrogatepass") for t, _, _ in flat]
    h, a, b, first = hashed_words(texts, ALNUM_WORDS)
    count = np.diff(first)
    of = np.repeat(np.arange(n), count)
    np.add.at(x, (of, PATH + (h % np.uint64(WORDS)).astype(np.int64)), (1 / np.sqrt(np.maximum(count, 1)))[of])
    size = np.array([len(t) for t, _, _ in flat], np.float32)
    link = np.array([k for _, _, k in flat], np.float32)
    place = np.concatenate([np.arange(len(p)) / len(p) for p in pages if p])
    marks = np.array([sum(map(t.count, ".!?;,")) for t, _, _ in flat], np.float32)
    at = PATH + WORDS
    x[:, at] = np.log1p(size) / 6
    x[:, at + 1] = np.minimum(link / np.maximum(size, 1), 1)
    x[:, at + 2] = np.log1p(count) / 5
    x[:, at + 3] = np.minimum(marks / np.maximum(count, 1) * 5, 2)
    x[:, at + 4] = [t[-1] in ".!?\"'”»…:" for t, _, _ in flat]
    x[:, at + 5] = place
    x[:, at + 6] = [len(p) / 8 for _, p, _ in flat]
    x[:, at + 7] = size > 80
    x[:, at + 8] = count <= 3
    x[:, at + 9] = [t.startswith(("©", "|", "»", "«", "•")) for t, _, _ in flat]
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Embedding, one LSTM for each direction, logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = PATH + WORDS + FIGURES
        self.p = {"E": rng.normal(0, 0.15, (d, EMBED)), "e": np.zeros(EMBED), "o": np.zeros(1), "O": rng.normal(0, 0.3, 2 * HIDDEN + EMBED)}
        for k in "fb":
            self.p |= {f"W{k}": rng.normal(0, 0.25, (EMBED, 4 * HIDDEN)), f"U{k}": rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)), f"c{k}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pass(self, z, mask, k, keep):
        """Hidden states over time (time, batch, HIDDEN); states carry over where the mask is 0."""
        T, B, _ = z.shape
        h, c = np.zeros((B, HIDDEN), np.float32), np.zeros((B, HIDDEN), np.float32)
        pre = z @ self.p[f"W{k}"] + self.p[f"c{k}"]
        out, saved = np.zeros((T, B, HIDDEN), np.float32), []
        for t in range(T) if k == "f" else range(T - 1, -1, -1):
            a = pre[t] + h @ self.p[f"U{k}"]
            i, f, o = (_sigmoid(a[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                saved.append((t, i, f, o, g, c, h, th, m))
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[t] = h
        return out, saved

    def forward(self, x, mask, keep=False):
        z = np.tanh(x @ self.p["E"] + self.p["e"])
        (hf, sf), (hb, sb) = self._pass(z, mask, "f", keep), self._pass(z, mask, "b", keep)
        top = np.concatenate([hf, hb, z], axis=2)
        return _sigmoid(top @ self.p["O"] + self.p["o"]), (z, top, sf, sb)

    def gradients(self, x, y, mask):
        prob, (z, top, sf, sb) = self.forward(x, mask, True)
        n = mask.sum()
        d = (prob - y) * mask / n
        g = {"O": np.einsum("tb,tbh->h", d, top), "o": np.array([d.sum()])}
        dtop = d[:, :, None] * self.p["O"]
        dz = dtop[:, :, 2 * HIDDEN :].copy()
        for k, saved, part in (("f", sf, slice(0, HIDDEN)), ("b", sb, slice(HIDDEN, 2 * HIDDEN))):
            gW, gU, gc = np.zeros_like(self.p[f"W{k}"]), np.zeros_like(self.p[f"U{k}"]), np.zeros_like(self.p[f"c{k}"])
            dh, dc = 0.0, 0.0
            for t, i, f, o, gg, c, h, th, m in reversed(saved):
                dh = dh + dtop[t][:, part]
                dnew = m * dc + m * dh * o * (1 - th**2)
                da = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), m * dh * th * o * (1 - o), dnew * i * (1 - gg**2)], axis=1)
                gW += z[t].T @ da
                gU += h.T @ da
                gc += da.sum(0)
                dz[t] += da @ self.p[f"W{k}"].T
                dh = da @ self.p[f"U{k}"].T + (1 - m) * dh
                dc = dnew * f + (1 - m) * dc
            g |= {f"W{k}": gW, f"U{k}": gU, f"c{k}": gc}
        dz *= 1 - z**2
        g["E"] = x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, EMBED)
        g["e"] = dz.sum((0, 1))
        return g

    def labels(self, pages: list[list]) -> list[np.ndarray]:
        """Probability that a leaf is main text, by page."""
        out: list = [np.empty(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        run: list[int] = []
        for i in [*order, None]:
            if run and (i is None or len(pages[i]) * (len(run) + 1) > 3000 and len(run) >= 1):
                x, mask = padded([pages[j] for j in run])
                prob, _ = self.forward(x, mask)
                for b, j in enumerate(run):
                    out[j] = prob[: len(pages[j]), b]
                run = []
            if i is not None:
                run.append(i)
        return out


def padded(pages):
    sizes = [len(p) for p in pages]
    x, mask = np.zeros((max(sizes), len(pages), PATH + WORDS + FIGURES), np.float32), np.zeros((max(sizes), len(pages)), np.float32)
    rows, at = encode(pages), 0
    for b, n in enumerate(sizes):
        x[:n, b], mask[:n, b] = rows[at : at + n], 1
        at += n
    return x, mask


# Usual names and words of the regions of a page.
REGIONS = {
    "nav": ("nav div ul", "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu pagination links toc", "home about contact news menu products services archive next previous page"),
    "header": ("header div", "header masthead site-header top logo banner topbar branding", "welcome the official site daily news search"),
    "notice": ("div section p aside", "cookie cookie-banner consent gdpr notice alert popup modal newsletter subscribe paywall privacy message", "we use cookies accept privacy policy subscribe newsletter settings agree sign up"),
    "ad": ("div aside ins section", "ad ads advert advertisement sponsored promo banner-ad adbox ad-slot commercial", "sponsored advertisement buy now offer sale free discount"),
    "aside": ("aside div section", "sidebar side widget related trending recommended popular more-stories aside rail teaser", "related popular trending read more also latest stories"),
    "form": ("form div", "form search login signup contact-form search-box register", "name email password search submit send login your message"),
    "comments": ("section div ol", "comments comment-list discussion responses replies comment-thread user-comments reader-comments", "comments reply says wrote ago like report posted by"),
    "footer": ("footer div", "footer site-footer copyright bottom legal colophon", "© copyright all rights reserved terms privacy contact imprint"),
    "share": ("div ul", "share social tags post-meta sharing follow", "share tweet facebook follow email print tags"),
}
MAIN_TAGS, MAIN_NAMES = "article main div section td", "article content post entry entry-content main story body-text article-body text post-content main-content page-content"
NOISE = "row col container wrap inner clearfix box block left right x1 m-2 grid wide"
_SYLLABLES = "an der en la que ti on re st ou ing th er al to ma ne lo vi sa che ge mi ra é ü ción ß"


class Templates:
    """Seeded pages with a label for each leaf."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self):
        return "".join(self.r.choice(_SYLLABLES.split()) for _ in range(self.r.randint(1, 4)))

    def prose(self, low, high):
        out = []
        for _ in range(self.r.randint(low, high)):
            n = self.r.randint(4, 18)
            out.append(" ".join(self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(n)).capitalize() + self.r.choice("...!?"))
        if self.r.random() < 0.1:
            out = [" ".join(w + self.r.choice(["***", "%%%", "$$$", "&&&", "!!"]) for w in s.split()) for s in out]
        return " ".join(out)

    def short(self, words):
        r = self.r
        return " ".join(r.choice(words.split()) if r.random() < 0.5 else self.word() for _ in range(r.randint(1, 5)))

    def open(self, tags, names, chance=0.75):
        r = self.r
        tag = r.choice(tags.split())
        mine = [r.choice(names.split())] if r.random() < chance or tag in ("div", "section", "p", "ul", "ol", "ins", "td") else []
        if r.random() < 0.25:
            mine.append(r.choice(NOISE.split()))
        if not mine:
            return f"<{tag}>", f"</{tag}>"
        key = r.choice(["class", "class", "id"])
        return f'<{tag} {key}="{" ".join(mine)}">', f"</{tag}>"

    def region(self, kind):
        """(html, number of leaves)."""
        r = self.r
        tags, names, words = REGIONS[kind]
        a, b = self.open(tags, names)
        if kind in ("nav", "share") or kind in ("aside", "footer") and r.random() < 0.5:
            n = r.randint(2, 9)
            items = [f'<a href="/{i}">{self.short(words)}</a>' for i in range(n)]
            head = r.random() < 0.3 and kind == "aside"
            body = ("<h3>" + self.short(words) + "</h3>") * head + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
            return a + body + b, n + head
        if kind == "comments":
            n = r.randint(1, 6)
            body = f"<h3>{self.short(words)}</h3>"
            for _ in range(n):
                body += r.choice(['<div class="comment">', "<div>", '<li class="reply">']) + f"<p>{self.short(words)}</p><p>{self.prose(1, 4)}</p></div>"
            return a + body + b, 1 + 2 * n
        if kind == "form":
            n = r.randint(1, 4)
            body = "".join(f"<p><label>{self.short(words)}</label><input name='x'></p>" for _ in range(n)) + f"<button>{self.short(words)}</button>"
            return a + body + b, n + 1
        if r.random() < 0.4 and not a.startswith("<p"):
            n = r.randint(1, 3)
            return a + "".join(f"<{t}>{self.prose(1, 2) if r.random() < 0.6 else self.short(words)}</{t}>" for t in (r.choice(["p", "div", "h2", "p"]) for _ in range(n))) + b, n
        return a + (self.prose(1, 2) if r.random() < 0.6 else self.short(words)) + b, 1

    def main(self):
        r = self.r
        a, b = self.open(MAIN_TAGS, MAIN_NAMES, 0.5)
        html, labels = a, []
        if r.random() < 0.85:
            head = f"<h1>{self.prose(1, 1)[:60]}</h1>"
            html += f"<header>{head}</header>" if r.random() < 0.15 else head
            labels.append(1)
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            x = r.random()
            if x < 0.62:
                html += f"<p>{self.prose(1, 6)}" + ("</p>" if r.random() < 0.9 else "")
                labels.append(1)
            elif x < 0.7:
                html += f"<p><b>{self.prose(1, 2)}<br>" + r.choice(["", "</b>", "</b></p>"])
                labels.append(1)
            elif x < 0.78:
                html += f"<h2>{self.short('part')}</h2>"
                labels.append(1)
            elif x < 0.84:
                n = r.randint(2, 5)
                html += "<ul>" + "".join(f"<li>{self.prose(1, 1)}</li>" for _ in range(n)) + "</ul>"
                labels += [1] * n
            elif x < 0.88:
                html += f"<blockquote>{self.prose(1, 3)}</blockquote>"
                labels.append(1)
            elif x < 0.9:
                html += f"<pre>{self.prose(1, 2)}</pre>"
                labels.append(1)
            elif x < 0.92:
                n = r.randint(1, 3)
                html += "<table>" + "".join(f"<tr><td>{self.short('a')}</td><td>{self.prose(1, 1)}</td></tr>" for _ in range(n)) + "</table>"
                labels += [1] * 2 * n
            else:
                h, n = self.region(r.choice(["ad", "share", "aside", "form", "notice"]))
                html += h
                labels += [0] * n
        return html + b, labels

    def page(self):
        r = self.r
        parts = [self.main()]
        zero = lambda k: (lambda h, n: (h, [0] * n))(*self.region(k))
        for k in ("ad", "notice", "header", "nav"):
            if r.random() < 0.55:
                parts.insert(0, zero(k))
        for k in ("share", "aside", "form", "comments", "ad", "notice", "footer"):
            if r.random() < 0.4 + 0.3 * (k == "footer"):
                parts.append(zero(k))
        if r.random() < 0.15:
            parts.insert(0, zero("aside"))
        a, b = self.open("div", "page wrapper container site", 1) if r.random() < 0.4 else ("", "")
        html = "<html><head><title>t</title></head><body>" + a + "\n".join(h for h, _ in parts) + b + "</body></html>"
        return html, [x for _, labels in parts for x in labels]


@lru_cache(maxsize=1)
def trained(pages: int = 700, epochs: int = 7, seed: int = 11) -> Labeller:
    made = Templates(seed)
    data = []
    while len(data) < pages:
        html, y = made.page()
        got = leaves(html)
        if len(got) == len(y):
            data.append((got, np.array(y, np.float32)))
    net, rng = Labeller(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    data.sort(key=lambda d: len(d[0]))
    batches = []
    for at in range(0, len(data), 20):
        part = data[at : at + 20]
        x, mask = padded([p for p, _ in part])
        y = np.zeros(mask.shape, np.float32)
        for b, (_, lab) in enumerate(part):
            y[: len(lab), b] = lab
        batches.append((x, y, mask))
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            step += 1
            for k, g in net.gradients(*batches[i]).items():
                g = g.astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.995 * v[k] + 0.005 * g * g
                net.p[k] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-7)
    return net


def main_text(net: Labeller, pages: list[str | None]) -> list[str]:
    got = [leaves(p) for p in pages]
    return ["\n".join(t for (t, _, _), p in zip(page, prob) if p >= THRESHOLD) for page, prob in zip(got, net.labels(got))]


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page; one pass, no shuffle."""
    cast = pages.sparkSession.sparkContext.broadcast(net or trained())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = main_text(cast.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col).cast("string"), html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
