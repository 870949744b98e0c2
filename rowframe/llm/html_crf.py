"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read by a tolerant tokenizer into its leaf blocks: runs of text between block-level tags, with the tags, class,
id and role words of their ancestors. The field scores each block's labels (boilerplate, main text) by ancestor and text
features and each pair of neighbouring labels; it is trained by exact gradients (forward-backward) on labelled pages and
decoded by Viterbi. The labelled pages come from a generator of layouts, whose labels are known by construction; in a
part of them class words mean nothing, so that the field also learns from tags, links and text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowframe.llm.rows import add_columns

#: Generated labelled pages, passes of training, and its step and ridge.
PAGES, PASSES, RATE, RIDGE = 600, 150, 0.15, 1e-4

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
#: The same where quotes are left open: a tag then ends at the next >.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_TAG_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements by their way with text.
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript object ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_RAW = frozenset("script style template title textarea iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCK - {"body", "html", "head", "button", "option", "select"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table html body".split())
#: Open elements that are kept; deeper ones are read as if they stood beside each other.
_DEEPEST = 192
#: Words in a block's text that tell of its use.
_TELLING = frozenset("cookie cookies subscribe newsletter advert advertisement sponsored copyright comment comments reply share login menu privacy terms related search accept".split())


class Block:
    """A leaf block: its text, and what its features are made of."""

    __slots__ = ("text", "tags", "words", "link", "seen_h1")

    def __init__(self, text: str, tags: tuple[str, ...], words: tuple[str, ...], link: float, seen_h1: bool):
        self.text, self.tags, self.words, self.link, self.seen_h1 = text, tags, words, link, seen_h1


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order; scripts, styles, titles and comments have none.

    Time grows as the page does: a tag without an end is text, and after the first one with an open quote tags end at
    the next >.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    in_link = 0
    seen_h1 = False
    beyond: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                words = tuple(dict.fromkeys(w for _, ws in stack for w in ws))
                blocks.append(Block(text, tuple(t for t, _ in stack if t in _BLOCK), words, min(1.0, linked / len(text)), seen_h1))
            parts.clear()
        linked = 0

    def close(names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        """Ends the innermost open element of ``names``, unless one of ``scope`` stands before it."""
        nonlocal in_link
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                in_link -= sum(t == "a" for t, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    at, n = 0, len(page)
    last, token = page.rfind(">"), _TOKEN
    while at < n:
        start = _TAG_START.search(page, at) if at <= last else None
        m = None
        if start and start.start() < last:
            m = token.match(page, start.start())
            if m is None and token is _TOKEN:
                token = _LOOSE
                m = token.match(page, start.start())
        if start and m is None and page.startswith("<!--", start.start()):
            m = token.match(page, start.start())
        upto = start.start() if m else n
        if upto > at:
            parts.append(html.unescape(page[at:upto]))
            if in_link > 0:
                linked += upto - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            if beyond.get(tag):
                beyond[tag] -= 1
                continue
            if tag == "p" or any(t == tag for t, _ in stack):
                close({tag}, frozenset())
            seen_h1 = seen_h1 or tag == "h1"
            continue
        if tag in _RAW:
            if tag == "textarea":
                flush()
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag in _ENDS_P:
                close({"p"}, _SCOPES)
            if tag in _SIBLINGS:
                close(_SIBLINGS[tag], _SCOPES)
        if tag in _VOID or m[3].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        if len(stack) >= _DEEPEST:
            beyond[tag] = beyond.get(tag, 0) + 1
            continue
        words: tuple[str, ...] = ()
        if m[3]:
            words = tuple(w for x in _NAMED.findall(m[3]) for w in _WORD.findall("".join(x).lower()))
        stack.append((tag, words))
        if tag == "a":
            in_link += 1
    flush()
    return blocks


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold of each block."""
    out = []
    n = len(blocks)
    for k, b in enumerate(blocks):
        words = b.text.split()
        size = len(words)
        own = ["bias", f"near:{b.tags[-1] if b.tags else ''}", f"size:{min(size.bit_length(), 8)}", f"link:{0 if b.link == 0 else 1 if b.link < 0.4 else 2 if b.link < 0.8 else 3}", f"place:{k * 5 // n}"]
        own += [f"in:{t}" for t in set(b.tags)]
        own += [f"word:{w}" for w in b.words]
        own.append(f"stop:{b.text[-1] in '.!?…:;'}:{size > 8}")
        own.append(f"h1:{b.seen_h1}:{size > 8}")
        if any(c in b.text for c in "©|»›"):
            own.append("sign")
        told = {x.strip('.,:!?').lower() for x in words} & _TELLING
        own += [f"says:{w}" for w in told] if size <= 12 else [f"tells:{min(len(told), 3)}"] if told else []
        own.append("same" if k and blocks[k - 1].tags[:-1] == b.tags[:-1] else "other")
        out.append(own)
    return out


# ------------------------------------------------------------------------------------------------- labelled pages

# Words that sites use in class names.
_MAIN_WORDS = "content post-body entry-content article-body story main-content article__text post text-body page-content".split()
_ASIDE_WORDS = {
    "ad": "ad ads advert ad-slot sponsored promo banner-ad".split(),
    "side": "sidebar side-bar widget related related-posts recommended trending".split(),
    "top": "header site-header masthead topbar breadcrumbs breadcrumb".split(),
    "menu": "menu navbar nav navigation main-menu".split(),
    "foot": "footer site-footer copyright legal".split(),
    "note": "cookie-notice cookie-banner notice consent gdpr popup alert newsletter subscribe".split(),
    "talk": "comments comment-list reader-comments discussion responses".split(),
    "form": "search login-form signup contact-form".split(),
    "share": "share social byline tags meta".split(),
}


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and the label of each of its leaf blocks (1: main text)."""
    plain = rng.random() < 0.3

    def named(words: list[str], tag: str) -> str:
        if plain and tag != "div":
            return f"<{tag}>"
        word = "c" + str(rng.randrange(900)) if plain else rng.choice(words)
        kind = rng.choice(("class", "class", "id", "role"))
        return f'<{tag} {kind}="{word}">' if rng.random() < 0.9 else f"<{tag}>" if tag != "div" else f'<div class="{word} box">'

    def text(lo: int, hi: int) -> str:
        ws = ["".join(rng.choice(("er", "an", "th", "on", "ich", "que", "la", "os", "tion", "é", "ung")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        for k in range(9, len(ws), 10):
            ws[k] += rng.choice((".", ",", "."))
        junk = rng.random()
        if junk > 0.9:
            ws[rng.randrange(len(ws))] = rng.choice(sorted(_TELLING))
        if junk < 0.06:
            ws = [w + rng.choice(("%%%", "***", "&amp;&amp;", "###", " |")) for w in ws]
        return " ".join(ws).capitalize() + rng.choice((".", ".", ".", "!", ""))

    out: list[str] = []
    labels: list[int] = []

    def put(markup: str, label: int, count: int = 1) -> None:
        out.append(markup)
        labels.extend([label] * count)

    def menu() -> None:
        tag = rng.choice(("nav", "nav", "div", "header"))
        k = rng.randint(3, 8)
        items = "".join(f'<li><a href="/{i}">{text(1, 2).strip(".!")}</a></li>' for i in range(k))
        put(f"{named(_ASIDE_WORDS['menu'], tag)}<ul>{items}</ul></{tag}>", 0, k)

    def note() -> None:
        kind = rng.choice(("ad", "ad", "note", "note", "share"))
        tag = rng.choice(("div", "div", "section", "aside", "p"))
        lead = {"note": "We use cookies. ", "ad": rng.choice(("", "Advertisement: ", "Sponsored ")), "share": "Share "}[kind] if rng.random() < 0.5 else ""
        inner = lead + text(3, 25)
        if tag != "p" and rng.random() < 0.5:
            inner = f"<p>{inner}</p>"
        if plain:
            tag = "aside" if tag != "p" else tag
            if tag == "p":
                inner = f'<a href="#">{inner}</a>'
        put(f"{named(_ASIDE_WORDS[kind], tag)}{inner}</{tag}>", 0)

    def top() -> None:
        tag = rng.choice(("header", "header", "div"))
        if plain:
            tag = "header"
        k = rng.randint(1, 2)
        put(f"{named(_ASIDE_WORDS['top'], tag)}" + "".join(f"<{t}>{text(1, 6)}</{t}>" for t in rng.choices(("div", "p", "h2", "h1"), k=k)) + f"</{tag}>", 0, k)

    def side() -> None:
        tag = "aside" if plain else rng.choice(("aside", "div", "section"))
        k = rng.randint(2, 5)
        rows = "".join(f'<li><a href="/r{i}">{text(3, 9)}</a></li>' for i in range(k))
        more = rng.random() < 0.5
        put(f"{named(_ASIDE_WORDS['side'], tag)}<h3>{text(1, 3)}</h3><ul>{rows}</ul>" + (f"<p>{text(8, 40)}</p>" if more else "") + f"</{tag}>", 0, k + 1 + more)

    def talk() -> None:
        tag = rng.choice(("section", "div"))
        k = rng.randint(1, 4)
        word = rng.choice(("comment", "reply", "response"))
        rows = "".join(f'<div class="{word}"><p>{text(5, 45)}</p></div>' for _ in range(k))
        put(f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(_ASIDE_WORDS["talk"])}"><h3>Comments</h3>{rows}</{tag}>', 0, k + 1)

    def form() -> None:
        put(f'{named(_ASIDE_WORDS["form"], "form")}<label>{text(1, 3)}</label><input type="text"><button>{text(1, 2)}</button></form>', 0, 2)

    def foot() -> None:
        tag = "footer" if plain else rng.choice(("footer", "footer", "div"))
        k = rng.randint(1, 3)
        put(f"{named(_ASIDE_WORDS['foot'], tag)}" + "".join(f"<p>{'&copy; ' if i == 0 else ''}{text(2, 14)}</p>" for i in range(k)) + f"</{tag}>", 0, k)

    def inner_noise() -> None:
        rng.choice((note, note, side, form))()

    def article() -> None:
        tag = rng.choice(("article", "article", "main", "div", "div"))
        if plain and tag == "div":
            tag = "article"
        wraps = [tag] if rng.random() < 0.6 else ["main", tag]
        for w in wraps:
            out.append(named(_MAIN_WORDS, w) if w == "div" or rng.random() < 0.4 else f"<{w}>")
        if rng.random() < 0.85:
            title = f"<h1>{text(2, 10)}</h1>"
            put(f"<header>{title}</header>" if rng.random() < 0.12 else title, 1)
        for _ in range(rng.randint(1, 11)):
            shape = rng.random()
            if shape < 0.6:
                put(f"<p>{text(1, 4) if rng.random() < 0.25 else text(4, 120)}</p>", 1)
            elif shape < 0.68:
                put(f"<p><b>{text(1, 20)}<br>", 1)
            elif shape < 0.74:
                put(f"<h{rng.randint(2, 4)}>{text(1, 7)}</h2>", 1)
            elif shape < 0.8:
                put(f"<blockquote>{text(6, 40)}</blockquote>", 1)
            elif shape < 0.86:
                k = rng.randint(2, 4)
                put("<ul>" + "".join(f"<li>{text(2, 25)}</li>" for _ in range(k)) + "</ul>", 1, k)
            elif shape < 0.9:
                put(f'<p>{text(3, 30)} <a href="/x">{text(1, 3)}</a> <em>{text(2, 9)}</em></p>', 1)
            elif shape < 0.93:
                put(f"<div>{text(6, 60)}</div>", 1)
            elif shape < 0.95:
                put(f"<pre>{text(6, 30)}</pre>", 1)
            elif not plain:
                inner_noise()
        for w in reversed(wraps):
            out.append(f"</{w}>")

    before = rng.choices((menu, note, top, side, form), k=rng.randint(0, 4))
    after = rng.choices((side, talk, note, foot, foot, form, menu), k=rng.randint(0, 4))
    for step in (*before, *((article,) if rng.random() < 0.97 else ()), *after):
        step()
    return f"<!DOCTYPE html><html><head><title>{text(1, 5)}</title><style>p{{}}</style></head><body>{''.join(out)}</body></html>", labels


# ------------------------------------------------------------------------------------------------------- the field


class Field:
    """Weights of (feature, label), of neighbouring labels and of a first label."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.weights = np.zeros((len(index), 2))
        self.pairs = np.zeros((2, 2))

    def scores(self, features: list[list[str]]) -> np.ndarray:
        get = self.index.get
        flat, ends = [], []
        for names in features:
            flat += [i for i in map(get, names) if i is not None]
            ends.append(len(flat))
        total = np.vstack((np.zeros((1, 2)), np.cumsum(self.weights[flat], axis=0))) if flat else np.zeros((1, 2))
        ends = np.array(ends, np.int64)
        return total[ends] - total[np.concatenate(([0], ends[:-1]))]

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not features:
            return []
        (stay0, to1), (to0, stay1) = self.pairs.tolist()
        a, b = 0.0, 0.0
        back = []
        for k, (s, t) in enumerate(self.scores(features).tolist()):
            if k == 0:
                a, b = s, t
                continue
            from_a = (a + stay0 >= b + to0, a + to1 >= b + stay1)
            a, b = s + max(a + stay0, b + to0), t + max(a + to1, b + stay1)
            back.append(from_a)
        label = int(b > a)
        labels = [label]
        for from_a in reversed(back):
            label = 0 if from_a[label] else 1
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], passes: int = PASSES, seed: int = 3) -> Field:
    """Maximum likelihood by exact gradients and Adagrad steps over all pages; a feature has to hold twice to count."""
    counts: dict[str, int] = {}
    for features, _ in pages:
        for names in features:
            for f in names:
                counts[f] = counts.get(f, 0) + 1
    field = Field({f: k for k, f in enumerate(sorted(f for f, c in counts.items() if c > 1))})
    pages = [p for p in pages if p[1]]
    n, most = len(pages), max(len(y) for _, y in pages)
    slot, feature, label = [], [], np.full((n, most), -1)
    for p, (features, y) in enumerate(pages):
        label[p, : len(y)] = y
        for k, names in enumerate(features):
            own = [field.index[f] for f in names if f in field.index]
            feature += own
            slot += [p * most + k] * len(own)
    slot, feature = np.array(slot), np.array(feature)
    there = label >= 0
    wordy = np.array([f.startswith("word:") for f in sorted(field.index, key=field.index.get)])
    rng = np.random.default_rng(seed)
    step_w, step_p = np.full(field.weights.shape, 1e-6), np.full((2, 2), 1e-6)
    truth = np.eye(2)[np.maximum(label, 0)] * there[:, :, None]
    for _ in range(passes):
        # class words are now and then hidden page by page, so that tags and text have to carry a page too
        hidden = rng.random(n) < 0.25
        use = ~(wordy[feature] & hidden[slot // most])
        s, f = slot[use], feature[use]
        score = np.stack([np.bincount(s, field.weights[f, y], n * most) for y in (0, 1)], axis=1).reshape(n, most, 2)
        ahead, log_a = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        log_a[:, 0] = score[:, 0]
        for t in range(1, most):
            log_a[:, t] = score[:, t] + np.logaddexp(log_a[:, t - 1, :1] + field.pairs[0], log_a[:, t - 1, 1:] + field.pairs[1])
        for t in range(most - 2, -1, -1):
            nxt = score[:, t + 1] + ahead[:, t + 1]
            on = np.logaddexp(field.pairs[:, 0] + nxt[:, :1], field.pairs[:, 1] + nxt[:, 1:])
            ahead[:, t] = np.where(there[:, t + 1, None], on, 0.0)
        joint = log_a + ahead
        share = np.exp(joint - np.logaddexp(joint[:, :, :1], joint[:, :, 1:])) * there[:, :, None]
        gap = (truth - share).reshape(-1, 2)
        grad = np.stack([np.bincount(f, gap[s, y], len(field.index)) for y in (0, 1)], axis=1) / n - RIDGE * field.weights
        both = there[:, 1:]
        pair = log_a[:, :-1, :, None] + field.pairs + (score[:, 1:] + ahead[:, 1:])[:, :, None, :]
        flat = pair.reshape(n, most - 1, 4)
        p = np.exp(flat - flat.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        seen = np.einsum("ntj,ntk->jk", truth[:, :-1] * both[:, :, None], truth[:, 1:])
        grad_p = (seen - (p * both[:, :, None]).sum(axis=(0, 1)).reshape(2, 2)) / n
        step_w += grad * grad
        step_p += grad_p * grad_p
        field.weights += RATE * grad / np.sqrt(step_w)
        field.pairs += RATE * grad_p / np.sqrt(step_p)
    return field


@lru_cache(maxsize=1)
def trained_field() -> Field:
    rng = random.Random(41)
    pages = []
    for _ in range(PAGES):
        page, labels = labelled_page(rng)
        features = block_features(leaf_blocks(page))
        if len(features) == len(labels):
            pages.append((features, labels))
    return train(pages)


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    labels = field.decode(block_features(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def _extract(shared):
    def extract(table: pa.Table) -> list[pa.Array]:
        field = shared.value
        texts = [main_text(page or "", field) for page in table["html"].to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return extract


def extract_main_text(pages: DataFrame, html_column: str = "html", keep: Sequence[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) plus text (empty if none) and n_chars, its code points.

    A null page is empty; a page is read whole, however long, malformed or deep. Rows that repeat are read each by
    itself; an empty table stays empty. Clashing columns of ``pages`` give way.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained_field())
    named = pages if html_column == "html" else pages.withColumnRenamed(html_column, "html")
    return add_columns(named, "text string, n_chars long", _extract(shared), ["html"], keep)


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")
