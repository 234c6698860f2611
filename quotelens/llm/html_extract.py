"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is content or not. Potentials of single elements
come from their names, classes, text and links; potentials of parent and child
tie each element to the one it lies in, so that a plain paragraph takes after its
surroundings. Messages go up the tree and down again, which gives each element's
exact marginal; text of elements more likely content than not is kept. Both kinds
of potentials are trained on labelled pages, by the gradient of their likelihood,
which the same messages give.

The trees of a batch are one forest in numpy, whose levels are worked off at
once; deep or large pages cost in proportion.

A null or empty page has an empty text. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import free_name
from quotelens.llm.pages import Page, labelled_pages, parse

#: Labelled pages to train on, and steps of the ascent.
TRAINING_PAGES = 400
STEPS = 150

# Element names and words in class, id and role that tell what an element is for.
TAG_GROUPS = (
    "article main",
    "nav menu",
    "header",
    "footer address",
    "aside",
    "form fieldset legend",
    "div section center",
    "p blockquote pre figure figcaption",
    "h1 h2",
    "h3 h4 h5 h6",
    "ul ol li dl dt dd",
    "table thead tbody tfoot tr td th caption",
    "body html",
)
NAME_WORDS = (
    "nav navbar menu breadcrumb breadcrumbs navigation pagination pager toolbar",
    "header masthead topbar top",
    "footer copyright colophon legal contentinfo",
    "sidebar side widget related recommended recommend teaser more popular trending rail complementary",
    "notice cookie cookies consent alert gdpr popup modal overlay warning",
    "ad ads adv advert advertisement adverts sponsored sponsor promo promotion banner",
    "comment comments reply replies respond discussion disqus",
    "share social tags tag meta byline author date",
    "search newsletter subscribe signup login contact form",
    "article post entry content main story body text page",
)
_WORDS = re.compile(r"[a-z]+")
_GROUP_OF = {t: i for i, group in enumerate(TAG_GROUPS) for t in group.split()}
_NAMED = {w: i for i, group in enumerate(NAME_WORDS) for w in group.split()}

#: Kinds of children that have parent-child potentials of their own.
KINDS = 5
N_TEXT = 8
N_FEATURES = 1 + len(TAG_GROUPS) + 1 + len(NAME_WORDS) + N_TEXT


@dataclass
class Forest:
    """The trees of several pages, one after the other."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    features: np.ndarray
    label: np.ndarray
    first: np.ndarray


def forest(pages: Sequence[Page]) -> Forest:
    sizes = np.array([len(p.tags) for p in pages], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = int(first[-1])
    parent, depth = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    x, label, kind = np.zeros((n, N_FEATURES)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    words, chars, linked, ended = (np.zeros(n) for _ in range(4))
    x[:, 0] = 1
    names_at = 2 + len(TAG_GROUPS)
    for page, at in zip(pages, first.tolist()):
        for i, (tag, name) in enumerate(zip(page.tags, page.names)):
            group = _GROUP_OF.get(tag, len(TAG_GROUPS))
            x[at + i, 1 + group] = 1
            found = {_NAMED[w] for w in _WORDS.findall(name) if w in _NAMED} if name else ()
            for k in found:
                x[at + i, names_at + k] = 1
            # Content box, other box by name or element, plain box, heading, text.
            other = group in (1, 2, 3, 4, 5) or any(k < len(NAME_WORDS) - 1 for k in found)
            own = group == 0 or len(NAME_WORDS) - 1 in found
            kind[at + i] = 1 if other else 0 if own else 2 if group in (6, 12) else 3 if group in (8, 9) else 4
        m = len(page.tags)
        parent[at : at + m] = np.array(page.parents) + at
        parent[at] = -1
        depth[at : at + m] = page.depths
        label[at : at + m] = page.labels
        linked[at : at + m] = page.linked
        for node, text in page.blocks:
            chars[at + node] += len(text)
            words[at + node] += text.count(" ") + 1
            ended[at + node] += text[-1] in ".!?:;\"'”»"
    below_chars, below_linked, below_words = chars.copy(), linked.copy(), words.copy()
    levels = _levels(depth)
    for rows in levels[:0:-1]:
        for total in (below_chars, below_linked, below_words):
            np.add.at(total, parent[rows], total[rows])
    whole = np.repeat(below_chars[first[:-1]], sizes) if n else below_chars
    t = x[:, -N_TEXT:]
    t[:, 0] = words > 0
    t[:, 1] = np.log1p(words) / 4
    t[:, 2] = np.divide(linked, chars, out=np.zeros(n), where=chars > 0).clip(0, 1)
    t[:, 3] = ended > 0
    t[:, 4] = (words > 0) & (words < 4)
    t[:, 5] = np.log1p(below_words) / 8
    t[:, 6] = np.divide(below_linked, below_chars, out=np.zeros(n), where=below_chars > 0).clip(0, 1)
    t[:, 7] = np.divide(below_chars, whole, out=np.zeros(n), where=whole > 0)
    return Forest(parent, levels, kind, x, label, first)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from the roots down."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def marginals(parent: np.ndarray, levels: list[np.ndarray], unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on a forest: marginals of each node, and of each node with its parent.

    ``unary``: log potentials, a row of two per node. ``pair``: log potentials by
    the parent's and the node's state. ``levels``: the nodes of each depth.
    """
    up, sent = unary.copy(), np.zeros_like(unary)
    for rows in levels[:0:-1]:
        sent[rows] = np.logaddexp.reduce(pair[rows] + up[rows][:, None, :], axis=2)
        np.add.at(up, parent[rows], sent[rows])
    belief, joint = up.copy(), np.zeros((len(unary), 2, 2))
    for rows in levels[1:]:
        # What the parent believes without what this child told it.
        both = (belief[parent[rows]] - sent[rows])[:, :, None] + pair[rows] + up[rows][:, None, :]
        both -= np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None]
        joint[rows] = np.exp(both)
        belief[rows] = np.logaddexp.reduce(both, axis=1)
    single = np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True)) if len(belief) else belief
    return single, joint


@dataclass
class Model:
    """Weights of features for content, and log potentials by kind of child, parent's and child's state."""

    weights: np.ndarray
    pairs: np.ndarray

    def content(self, f: Forest) -> np.ndarray:
        """The probability of each node to be content."""
        unary = np.stack([np.zeros(len(f.parent)), f.features @ self.weights], 1)
        return marginals(f.parent, f.levels, unary, self.pairs[f.kind])[0][:, 1]


def train(pages: Sequence[str], steps: int = STEPS) -> Model:
    """Potentials that make the labels of ``pages`` (``data-label`` attributes) most likely.

    Ascent on the mean log likelihood with a small quadratic penalty, each step
    scaled by the running size of its gradient.
    """
    f = forest([parse(p) for p in pages])
    model = Model(np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2)))
    child = f.parent >= 0
    rows, above = f.label[child], f.label[f.parent[child]]
    seen_pairs = np.zeros_like(model.pairs)
    np.add.at(seen_pairs, (f.kind[child], above, rows), 1)
    size = len(f.parent)
    moment = [np.zeros_like(model.weights), np.zeros_like(model.pairs)]
    square = [np.zeros_like(model.weights), np.zeros_like(model.pairs)]
    for step in range(1, steps + 1):
        unary = np.stack([np.zeros(size), f.features @ model.weights], 1)
        single, joint = marginals(f.parent, f.levels, unary, model.pairs[f.kind])
        expected = np.zeros_like(model.pairs)
        np.add.at(expected, f.kind[child], joint[child])
        slopes = [
            f.features.T @ (f.label - single[:, 1]) / size - 1e-4 * model.weights,
            (seen_pairs - expected) / size - 1e-4 * model.pairs,
        ]
        for i, (values, slope) in enumerate(zip((model.weights, model.pairs), slopes)):
            moment[i] = 0.9 * moment[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope**2
            values += 0.1 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(1)
def default_model() -> Model:
    """Trained on ``TRAINING_PAGES`` pages of known layout; the same in every session."""
    return train(labelled_pages(TRAINING_PAGES))


def texts_of(model: Model, sources: Sequence[str | None]) -> list[str]:
    """The main text of each page: its content blocks in page order, one a line."""
    pages = [parse(s or "") for s in sources]
    f = forest(pages)
    content = model.content(f) > 0.5
    return [
        "\n".join(text for node, text in page.blocks if content[at + node])
        for page, at in zip(pages, f.first.tolist())
    ]


def extract_pages(df: DataFrame, source: str = "html", out: str = "text", model: Model | None = None) -> DataFrame:
    """``df`` without ``source`` and with the main text of each page in ``out``, row by row.

    ``model``: from :func:`train`, by default that of the built-in labelled pages;
    a few hundred numbers, which go to the tasks with the code. ``out`` replaces a
    column of that name.
    """
    kept = [c for c in df.columns if c not in (source, out)]
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                found = texts_of(model, some.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[: len(kept)], pa.array(found, pa.string())], names=[*kept, out]
                )

    schema = df.select(*kept).schema.add(out, "string")
    (page,) = free_name(df, "__html")
    return df.select(*kept, F.col(source).cast("string").alias(page)).mapInArrow(run, schema)
