import random

from lexiloom.llm import spam
from tests.llm.samples import lines


def word():
    return "".join(random.choice("bdfgklmnprstvz") + random.choice("aeiou") for _ in range(random.randint(2, 4)))


def varied(lang, n):
    """Sentences of a language with invented nouns, as varied as ordinary text."""
    return " ".join(f"{x.removesuffix('.')} {word()} {word()} {word()}." for x in random.sample(lines(lang), n))


def pages():
    random.seed(4)
    out, i = [], 0
    for lang in ("en", "de"):
        for _ in range(120):
            i += 1
            out.append((i, varied(lang, 8), lang, 0))
    phrases = ["cheap locale pack", "best plugin", "free language files", "top tool"]
    bad = [
        "\n".join(random.choice(phrases) for _ in range(60)),
        " | ".join(random.choice(phrases) for _ in range(60)),
        "\n".join(f'<a href="https://x{n}.example/?q=a">{random.choice(phrases)}</a>' for n in range(40)),
        " ".join("#" + random.choice(phrases).title().replace(" ", "") for _ in range(40)),
        " ".join(f"Our {a} is the {b} for {a} and the {b} you want." for a, b in [random.choices(phrases, k=2) for _ in range(25)]),
        lines("en")[0] + "\n\n" + ", ".join(random.choice(phrases) for _ in range(80)),
    ]
    good = [
        "\n".join(f"- {varied('en', 1)}" for _ in range(10)),
        "\n".join(f"- [name](https://x.example/{n}): {varied('en', 1)}" for n in range(10)),
        "\n".join(f"| a.b | {varied('en', 1)} |" for _ in range(10)),
        varied("en", 8) + "\n\nTags: profile, confirm\n\n[a](https://x.example/)",
        "```\n" + "\n".join("const x = call();" for _ in range(50)) + "\n```\n" + varied("en", 6),
        (varied("en", 1) + " ") * 40,
    ]
    return out, [(1000 + k, t, "en", 0) for k, t in enumerate(bad)], [(2000 + k, t, None, 0) for k, t in enumerate(good)]


def test_pages(spark):
    usual, bad, good = pages()
    rest = [(3000, None, "en", 0), (3001, "", "en", 0), (3002, " \n", None, 0), (3003, "short", "xx", 0), (1000, bad[0][1], "en", 0), (3004, varied("en", 60) * 100, "en", 0)]
    df = spark.createDataFrame(usual + bad + good + rest, "doc_id long, text string, lang string, distance int")
    got = [r.doc_id for r in spam.found(df).collect()]
    assert sorted(got) == sorted([b[0] for b in bad] + [1000])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert spam.found(df).collect() == []


def test_links_of_any_length(spark):
    usual, _, _ = pages()
    long_links = "\n".join(f"[{'cheap locale pack ' * 120}](https://x.example/{'q' * 2000}{n})" for n in range(12))
    short = "#LocalePack #BestPlugin #LocalePack #TopTool #BestPlugin #LocalePack #TopTool #BestPlugin"
    assert spam.units_of(f"[{'a ' * 500}](https://x.example/{'q' * 2000})")[1] > 2900
    df = spark.createDataFrame([r[:3] for r in usual] + [(5000, long_links, "en"), (5001, short, "en"), (5002, "#One", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in spam.found(df).collect()} == {5000, 5001}
