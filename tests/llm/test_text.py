"""Quality rules, decontamination, encoding, chat, models."""

import hashlib
import json
import math
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadloom.llm import bpe, chat, decontaminate, language_id, quality_model, quality_rules

from .helpers import corpus, words

PATH = public_tokenizers.path("word_bpe_49k.json")


# ---- quality rules


def brute_measures(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_rules(spark, odd, empty):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b#", "c\n", "d|", "e\n"]) for _ in range(rng.randint(0, 120))) for _ in range(60)] + [t for _, t in corpus()] + [None]
    got = quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_measures(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(odd).count() == odd.count()
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.keep_good(empty).count() == 0


def test_line_verdicts():
    # no three words in a row are repeated, so the base rules pass
    prose = [" ".join(f"{w}{k}" for w in "An ordinary sentence of some text about & around things which stay".split()) + "." for k in range(8)]
    junk = ["Home | About | Contact | Imprint", "BUY!! NOW!! CHEAP!! OFFER!!", "word### next$$$ some*** more%%%", "Licensed under the Apache License, Version 2.0."]
    text = "\n".join([*prose, *junk, ""])
    clean, values = quality_rules.judge(text)
    assert clean == "\n".join([*prose, ""])
    assert values[6] and values[8] == 4
    noisy = "\n".join(f"word{k}### next{k}$$$ some{k}*** more{k}%%%" for k in range(20))
    assert quality_rules.judge(noisy)[1][5:7] == (False, False)


def test_boilerplate_is_whole_phrases_in_short_lines():
    fails = lambda line: quality_rules.line_fails(line, words(line))
    assert fails("Please SIGN IN to continue.") and fails("sign in") and fails("(Sign in)")
    assert not fails("They assign in turn what the design in question asks for.") and not fails("A blog in town")
    assert not fails("Before the vote, members sign in at the desk, " + "and then they take their seats in the hall " * 4)


# ---- decontamination

BENCH = [
    (1, "A farmer named Anna has 12 apples and gives 5 kg of apples to her neighbour Ben before noon on a sunny day in spring"),
    (2, "Which of the following rivers flows through the largest number of countries on its way to the black sea and beyond"),
    (3, "short one"),
    (4, None),
    (2, "Which of the following rivers flows through the largest number of countries on its way to the black sea and beyond"),
]
OTHER = "Some text before it, quite harmless. "
CASES = [
    (10, OTHER + BENCH[0][1] + ". And more.", True),
    (11, OTHER + BENCH[0][1].replace("Anna", "Clara").replace("12", "30").replace("5 kg", "7kg"), True),  # other values, same slots
    (12, OTHER + BENCH[1][1].upper(), True),
    (13, OTHER + " ".join(BENCH[1][1].split()[3:17]), True),  # fourteen words in a row
    (14, OTHER + " ".join(BENCH[1][1].split()[3:10]), False),
    (15, OTHER + "The sea is black and the rivers are following their way", False),
    (16, None, False),
    (17, "", False),
    (18, OTHER + BENCH[1][1].replace("rivers", "streams"), True),  # one word changed still leaves a run of over thirteen
]


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert {i: r.contaminated for i, r in got.items()} == {i: x for i, _, x in CASES}
    assert got[10].item_id == 1 and got[12].item_id == 2 and got[12].n_items == 1
    kept = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, x in CASES if not x]
    for b in (bench, bench.limit(0)):
        assert decontaminate.decontaminate(odd, b).count() == odd.count()
        assert decontaminate.decontaminate(empty, b).count() == 0
        assert decontaminate.drop_contaminated(odd, b).columns == odd.columns


def test_slots_must_agree(spark):
    """The same number twice in the benchmark has to be the same number twice in the document."""
    item = "first take 4 of them then add 9 to it and finally put back 4 of them where all of it was found"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    same, mixed = item.replace("4", "6"), item.replace("4", "6", 1)
    docs = spark.createDataFrame([(1, same), (2, mixed), (3, item.replace("9", "4"))], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: True, 2: False, 3: False}


# ---- encoding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBPE(PATH)


PARTS = ["a", "b", "the", "th", "in", "é", "ß", "Ñ", "1", "２", "½", "'", "'re", "'r", "!", "<|endoftext|>", "<|", "|>", " ", "\t", "\n", "\x85", "\xa0", "İ", "Σ", "ς", "中", "é", "😀", "‍", "\x1c", "\x00", "--", "Ǆ", "ﬁ", "ŉ", "\xad"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=25).map("".join))
def test_encoding_is_the_librarys(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode_batch([text]) == [ids]
    assert coder.count_batch([text]) == [len(ids)]
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_and_small_memory(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    texts = ["a" * 3000, "th" * 500, "!" * 700, "é" * 800, *(t for _, t in corpus())]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [coder.encode_batch([t])[0] for t in texts] == want


def test_prefix_counts(coder, library):
    text = "Don't they're unbelievably, <|endoftext|> we'll see! 123 abc"
    table = coder.prefix_table(text)
    flat = [p if isinstance(p, str) else coder.names[p] for p in coder.pieces(text)]
    at = 0
    for k, piece in enumerate(flat):
        for n in range(1, len(piece) + 1):
            part = " ".join([*flat[:k], piece[:n]])
            assert table.count(at + n) == len(library.encode(part, add_special_tokens=False).ids), part
        at += len(piece)
    for budget in range(table.tokens[-1] + 2):
        assert table.cut(budget) == max(k for k in range(table.bytes[-1] + 1) if table.count(k) <= budget)
    assert table.cut(10**6) == table.bytes[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([p for p in PARTS if p not in ("\u200d", "e\u0301")] + ["unbelievably", "they're", "ünïcödé"]), max_size=8).map("".join))
def test_cuts_are_longest(coder, text):
    """The longest prefix, of whole characters, for every budget."""
    table = coder.prefix_table(text)
    raw = b"".join((coder.names[p] if isinstance(p, int) else p).encode("utf-8", "surrogatepass") for p in coder.pieces(text))
    ends = [k for k in range(len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80]
    assert table.bytes[-1] == len(raw)
    for budget in range(table.tokens[-1] + 2):
        assert table.cut(budget) == max(k for k in ends if table.count(k) <= budget)
        n = table.tokens[-1]
        assert coder.cut_batch([text, text], budget) == [(n, table.cut(budget))] * 2


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    for part in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        (tmp_path / "v.json").write_text(json.dumps(spec | part), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.WordBPE(str(tmp_path / "v.json"))


def test_encoding_operators(spark, odd, empty, library):
    docs = spark.createDataFrame([*corpus(), (900, None)], "doc_id long, text string")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.bpe_encode(docs, PATH, ids=True, decoded=True).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    for r in bpe.token_counts(docs, PATH, limit=50).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 50)
    for f in (bpe.bpe_encode, bpe.token_counts):
        assert f(odd, PATH).count() == odd.count()
        assert f(empty, PATH).count() == 0


# ---- chat

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd|>"]), st.lists(st.sampled_from(["\\", "<", "|", ">", "<|", "[INST]", "[/INST]", "</s>", "a", "\n", "<|end|>"]), max_size=8).map("".join)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_chat_round_trip(turns):
    t = chat.MarkedTemplate()
    out = chat.layout(t.render, turns)
    assert t.parse(out.formatted) == turns
    assert [t.unescape(out.formatted[a:b]) for a, b in out.bodies] == [x for _, x in turns]
    assert not out.rewrites and all(c not in t.escape(x) for _, x in turns for c in t.controls)


def test_chat_rewriting_and_long_conversations():
    def hides(turns):  # a template that drops all but the last turn's text
        return "".join(f"[{r}:{x if k == len(turns) - 1 else ''}]" for k, (r, x) in enumerate(turns))

    assert chat.layout(hides, [("u", "hello"), ("a", "yes")]).rewrites
    assert chat.layout(hides, [("u", f"hello{k}") for k in range(50)]).rewrites
    turns = [("user" if k % 2 else "assistant", f"text {k} <|end|>") for k in range(500)]
    t = chat.MarkedTemplate()
    out = chat.layout(t.render, turns)
    assert [t.unescape(out.formatted[a:b]) for a, b in out.bodies] == [x for _, x in turns]
    assert out.spans[-1][1] == len(out.formatted)


def test_chat_marks_at_some_turns():
    """A template that adds a mark before the last turn of 7, 17, 27… turns rewrites history at any length from 8 turns."""
    def marks(turns):
        out = [f"[{r}:{x}]" for r, x in turns]
        return "".join(out[:-1]) + "*" * (len(turns) % 10 == 7) + "".join(out[-1:])

    for n in (6, 8, 20, 32, 33, 40, 75):
        assert chat.layout(marks, [("u", f"text {k}") for k in range(n)]).rewrites == (n > 7)


def test_chat_very_long_text(spark):
    text = "</s>[INST] long " * 20_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    (got,) = chat.chat_digests(chat.format_chat(df)).collect()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_chat_operator(spark):
    rows = [(1, 0, "user", "hi"), (1, 2, "assistant", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, None, "user", "u"), (2, 0, "assistant", "</s>[INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' formatted", "1 spans")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chat(df)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == digest([("user", "hi"), ("", "x"), ("", "x"), ("assistant", "")])
    assert got[2].loss_sha256 == hashlib.sha256(b"</s>[INST]").hexdigest() and got[2].loss_chars == 10
    assert got[None].turns_sha256 == digest([("user", "u")])
    assert chat.format_chat(df.limit(0)).count() == 0


# ---- models


def test_suffix_automaton():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 40)))
        a = language_id.SuffixAutomaton(text)
        probe = "".join(rng.choice("abc ") for _ in range(25))
        n, k = 0, 0
        while k < len(probe):
            size = max((m for m in range(1, len(probe) - k + 1) if probe[k : k + m] in text), default=1)
            n, k = n + 1, k + size
        assert a.phrases(probe) == n


def _languages(n=160):
    rng = random.Random(6)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["é", "eau", "tion", "que"]}
    return [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))), lang) for k in range(n) for lang in [rng.choice(list(parts))]]


def brute_phrases(learned, probe, segment):
    """Greedy parse by searching the learned text for every longer piece."""
    n = 0
    for at in range(0, len(probe), segment):
        part, k = probe[at : at + segment], 0
        while k < len(part):
            size = 1
            while k + size < len(part) and part[k : k + size + 1] in learned:
                size += 1
            n, k = n + 1, k + size
    return n


@pytest.mark.parametrize("segment", [7, 4096])
def test_cross_parsing(monkeypatch, segment):
    """Predictions and scores by brute force; more letters than codes, so that some share one."""
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    rng = random.Random(5)
    many = "".join(chr(0x4E00 + k) for k in range(80))
    words = {"aa": ["ka", "lo", "mi"], "bb": ["lo", "un", "ber"], "cc": list(many)}
    write = lambda lang, n: " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    texts = {lang: write(lang, 60) for lang in words}
    parser = language_id.CrossParser(texts)
    probes = [write(rng.choice(list(words)), rng.randint(1, 40)) + rng.choice(["", "!! 12 xyz", " Ä"]) for _ in range(40)]
    got = parser.predict_batch([*probes, None, "", "12 !"])
    assert got[40:] == [("und", 0.0)] * 3
    string = lambda t: "".join(map(chr, parser.code(t)))
    for t, (lang, score) in zip(probes, got):
        coded = string(t)
        rates = sorted((brute_phrases(string(x), coded, segment) * math.log2(len(string(x))) / len(coded), k) for k, x in texts.items())
        assert lang == rates[0][1] and score == pytest.approx(rates[1][0] / (rates[0][0] + rates[1][0]))


def test_no_language_is_left_out(spark):
    rows = [(k, f"words of language number {chr(97 + k % 26) * 3} {chr(97 + k // 26 % 26) * 4}", f"l{k % 700:03}") for k in range(4200)]
    texts = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(texts) > 690 and sum(map(len, texts.values())) <= language_id.ALL_CHARS


def test_language_identification(spark, odd, empty):
    rows = [*_languages(), (900, None, "aa"), (901, "123 !!", "bb"), (902, "ka lo", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify_language(df).collect()}
    held = [i for i, _, lang in rows[:160] if got[i].held_out]
    assert len(held) > 20 and all(got[i].lang_pred == rows[i][2] for i in held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify_language(odd).count() == odd.count()
    assert language_id.identify_language(empty).count() == 0
    none = language_id.identify_language(df.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_quality_model(spark, odd, empty):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.7
        w = [rng.choice("the of and house river goes under".split()) for _ in range(rng.randint(30, 90))]
        rows.append((k, " ".join(w) if good else " ".join(x + rng.choice(["###", "$$$", "!!"]) for x in w)))
        labels.append((k, int(good), 0))
    labels += [(1, None, None), (None, 1, 0), (2, labels[2][1], 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, marks)
    got = {r.doc_id: r for r in quality_model.score_quality(docs, model).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 80
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert quality_model.score_quality(odd, model).count() == odd.count()
    assert quality_model.score_quality(empty, model).count() == 0
    blank = quality_model.fit(odd, marks.limit(0))
    assert {r.score for r in quality_model.score_quality(odd, blank).collect()} == {0.5}
