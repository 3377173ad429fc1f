from __future__ import annotations

import random

import pytest

WORDS = {
    "en": "the of and to in is was for on that with as be at by house river stone green light under early winter market people always never between".split(),
    "fr": "le la les de des et un une dans pour sur que qui avec maison rivière été où déjà très peuple jamais entre après forêt être".split(),
    "de": "der die das und ist nicht mit von für auf ein eine haus fluss grün über während straße immer zwischen früh müssen können größe".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice("abcdefgh") * rng.randint(0, 3) if rng.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with copies, near copies, shared passages, odd texts, and columns that clash with inner names."""
    return spark.createDataFrame(ROWS, SCHEMA)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, spans string, n long, row long, bits string, component string, score double"


def _rows() -> list[tuple]:
    rng = random.Random(7)
    texts: list[tuple[str | None, str | None]] = []
    for k in range(90):
        lang = ("en", "fr", "de")[k % 3]
        texts.append((prose(rng, lang, rng.choice((3, 8, 40, 120, 300))), lang))
    shared = prose(rng, "en", 40)
    for k in range(12):
        texts.append((f"{prose(rng, 'fr', 30)} {shared} {prose(rng, 'fr', 20)}", "fr"))
    base = prose(rng, "en", 150).split()
    for k in range(12):
        near = list(base)
        for _ in range(k // 3):
            near[rng.randrange(len(near))] = "changed"
        texts.append((" ".join(near), "en"))
    texts += [(texts[3][0], "en")] * 6
    texts += [(None, None), ("", "en"), ("  \t\n ", "de"), ("12 34 !!", "en"), ("\x85\xa0word", "en"), ("😀 ünïcode 文字 text " * 5, None), ("one two three four", "en"), ("ONE two three four", "en")]
    texts += [("Mail me at a.b@mail.example.com or +1 (724) 555-3457, card 4811329106135696 from 74.115.213.212.", "en"), (prose(rng, "de", 20_000), "de"), ("x" * 30_000, "en"), ("1" * 20_000 + "." + "1." * 5000 + "+" + "1" * 5000, "en")]
    rows = [(k, t, lang, f"s{k % 5}" if k % 7 else None, None if t is None else len(t)) for k, (t, lang) in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    return [(*r, 1, "k", "x", 2, 3, "b", "c", 0.5) for r in rows]


ROWS = _rows()
