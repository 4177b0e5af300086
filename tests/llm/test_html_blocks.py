"""Leaf blocks of pages: formulas, drawings, fallback text, deep nesting; Viterbi against all labellings."""

import itertools
import random

import numpy as np

from logloom.llm import html


def texts(page):
    return [b.text for b in html.blocks(page)]


def test_formulas_drawings_and_fallbacks_are_text():
    assert texts("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == ["where x=1 holds"]
    assert texts("<p>see <svg><path d='m'/><text>label</text><style>a{}</style></svg> here</p><p>next</p>") == ["see label here", "next"]
    assert texts("<div><object>no player</object> <canvas>chart</canvas></div><noscript>plain form</noscript>") == ["no player chart", "plain form"]
    assert texts("<p>open <svg><g><text>a</text><p>not lost</p><div>after</div>") == ["open a", "not lost", "after"]
    assert texts("<p>a</p><script>x<y</script><textarea>t</textarea><template>t</template><select><option>o</select>b") == ["a", "b"]


def test_ancestors_count_at_any_depth():
    page = "<article class='story'>" + "<div>" * 200 + "deep" + "</div>" * 200 + "</article><div>out</div>"
    deep, out = html.blocks(page)
    assert {"a:article", "c:story", "p:div"} <= set(html._path_features(deep.path)) and len(deep.path) == 2
    assert html._path_features(out.path) == ["a:div", "p:div"]
    # far below, the innermost element is told from an equal one further out
    inner = html.blocks("<div><section>x<div>y</div>z</section></div>")
    assert [html._path_features(b.path) for b in inner] == [["a:div", "a:section", "p:section"], ["a:div", "a:section", "p:div"], ["a:div", "a:section", "p:section"]]


def test_viterbi_equals_all_labellings():
    rng = random.Random(4)
    field = html.Field()
    tags = ["p", "div", "nav", "li"]
    names = [f"{k}:{t}" for k in "ap" for t in tags] + ["bias", "first:True", "last:True", "end:True", "end:False"]
    field.ids = {f: i for i, f in enumerate(names)}
    for _ in range(60):
        field.weights = np.array([[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in names])
        field.pairs = np.array([[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"])
        field.paths.clear()
        chain = [html.Block(rng.choice(["One.", "two"]), tuple(rng.choices(tags, k=2)), 0, -1) for _ in range(rng.randint(1, 9))]

        def score(labels):
            total = sum(field.pairs[a, b] for a, b in itertools.pairwise(labels))
            for k, (b, y) in enumerate(zip(chain, labels, strict=True)):
                features = html._path_features(b.path) + html._text_features(b, k, len(chain))
                total += sum(field.weights[field.ids[f], y] for f in features if f in field.ids)
            return total

        best = max(score(x) for x in itertools.product((0, 1), repeat=len(chain)))
        assert abs(score(field.label(chain)) - best) < 1e-9
