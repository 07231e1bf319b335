import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import HARD, LOWER, documents, rows

import corpus_pipeline
from corpusmill.llm import chat as C
from corpusmill.llm import packing as K
from corpusmill.llm import pages as G
from corpusmill.llm import toxicity as X
from corpusmill.llm.decontaminate import contamination
from corpusmill.llm.queries import op4_chat_format, word_bpe_path
from pyspark.sql import functions as F

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies, ok?</div><ul id="main-menu"><li><a href="/">Home</a></ul>
<div id="wrap"><div class="content"><h2>Title &amp; more</h2><p>First para, with <b>bold</b> text and a <a href="x">link</a>.<p>Second&nbsp;para<br>line two. It is long, quite long, and it goes on.<ul><li>Item one<li>Item two, ok.</ul><blockquote>Quote here.</blockquote><p>End.</p>
<div class="ad-slot">Buy now, cheap!</div><form><input><label>Name</label></form><div class="comments"><p>Great post, thanks! I really liked it, very very much, and more.</p></div></div>
<div class="sidebar"><p>About me, this is a long text of the sidebar, really.</p></div></div><aside>aside text</aside><footer>&copy; 2024</footer><script>var x="<p>no</p>";</script></body></html>"""


def test_page_text(spark):
    want = "Title & more\nFirst para, with bold text and a link.\nSecond para line two. It is long, quite long, and it goes on.\nItem one\nItem two, ok.\nQuote here.\nEnd."
    pages = ["", None, PAGE, "plain, text.", "<nav><a>x</a></nav>", "<", '<p>a<p class="x', "<article><h1>H</h1><p>S.</p></article><div><p>" + "Not, the article. " * 3 + "</p></div>"]
    df = spark.createDataFrame([(i, f"u{i}" if i else None, h) for i, h in enumerate(pages)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = rows(G.extract(df))
    assert [r[2] for r in got][:6] == ["", "", want, "plain, text.", "", "<"] and got[2][3] == len(want) and got[0][1] is None
    assert rows(G.extract(df.limit(0))) == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body><form id="aspnetForm"><div id="header">Site name, here</div><div class="story"><h1>Title</h1><p>Text one, good and long enough.</p><p>Two.</p></div><div id="footer">foot</div></form></body>', "Title\nText one, good and long enough.\nTwo."),
        (
            '<body><div class="page-with-sidebar"><article class="post ad-free"><header class="entry-header"><h1>T</h1></header><p>Body, text. Of some length here.</p><aside>rel</aside><section id="comments">'
            '<article class="comment"><p>I like this very much, thank you all for it. Great, great, great.</p></article></section></article><div role="alert">Warning, now</div></div></body>',
            "T\nBody, text. Of some length here.",
        ),
        ("<table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>Head</h1><p>The article, in a table. It has text.</p><p>More of it, here.</p></td></tr></table>", "Head\nThe article, in a table. It has text.\nMore of it, here."),
        ("<body><div><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div><div><p>The article text, long enough to count, really.</p><p>And more of it. Yes.</p></div></body>", "The article text, long enough to count, really.\nAnd more of it. Yes."),
    ],
)
def test_page_shapes(page, want):
    assert G.main_text(page) == want


def test_page_paths():
    page = G.Page("<div><p>A long text, with marks. And more, of it.</p><a>x</a></div>")
    assert G.content_nodes(page, page.texts).tolist() == [True, True] or G.content_nodes(page, page.texts)[0]


@pytest.fixture(scope="module")
def tokenizer():
    return K.WordTokenizer(word_bpe_path())


def test_tokenizer_is_exact(tokenizer):
    rng = random.Random(1)
    texts = ["it's we'll I'D don''t", "a b", "İstanbul ſ ﬁ", "<|endoftext|> x", "été", "½ ² 12 a1b2", "日本語 テキスト", "“q” – … ‘s’", "", "   ", "\x1c a", "''s -'s 's", "a\x00b", "x" * 5000]
    texts += ["".join(rng.choice("ab'sté ßÀ12.-½ª“\n\tŸſİ") for _ in range(40)) for _ in range(500)]
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert np.frombuffer(ids, np.uint16).tolist() == tokenizer.inner.encode(text, add_special_tokens=False).ids


def test_hilbert_is_a_path():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = K.hilbert(cells, 3)
    assert sorted(place) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_packing_round_trip(spark, tokenizer):
    texts = [*HARD, *[f"word{i % 5} " * (i * 37 % 900) for i in range(60)]]
    got = [r.asDict() for r in K.pack(documents(spark, texts), word_bpe_path()).collect()]
    ids = {i: [*tokenizer.inner.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] == len(own) > 0 and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, whole in [(pieces[i], len(ids[i])) for i in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == whole or whole is None and (at == K.SEQUENCE or at & (at - 1) == 0)
    assert rows(K.pack(documents(spark, ["a"]).limit(0), word_bpe_path())) == []


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["\\", "<s>", "</s>", "[TEXT]", "[/INST]", "<", "s>", "/", "[", "INST]", "a", "é", "😀", "\n", " ", "$1", "TEXT]", "[IMAGE]"]
    data, want = [], {}
    for c in range(60):
        turns = [(t, rng.choice(["user", "assistant", "sys<s>\\", None]), None if rng.random() < 0.05 else "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for t in range(rng.randrange(1, 300 if c < 2 else 6))]
        data += [(c, *t) for t in rng.sample(turns, len(turns))]
        text = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
        loss = "".join(x or "" for _, r, x in turns if r == "assistant")
        want[c] = (c, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", C.text_part(F.col("text")).alias("parts"), F.lit(1).alias("mask"), F.lit(2).alias("body"))
    assert rows(C.conversation_digests(C.format_conversations(df)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want.values())
    assert rows(C.format_conversations(df.limit(0))) == []


def test_chat_parts_and_hostile_texts(spark, sf):
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"
    df = spark.sql(f"""SELECT 1L AS conv_id, CAST(NULL AS BIGINT) AS turn, 'user' AS role, from_json('[{{"type":"text","text":"see [IMAGE]"}},{{"type":"image","ref":"a"}},{{"type":"Audio","ref":"b","tokens":10}},{{"type":"document"}}]', 'array<{part}>') AS parts
        UNION ALL SELECT 1L, 1L, 'assistant', NULL UNION ALL SELECT 1L, 1L, 'assistant', NULL""")
    got = C.format_conversations(df).head()
    assert got["formatted"] == "<s>user[TEXT]see [\\IMAGE][IMAGE][AUDIO][DOCUMENT]</s>" + "<s>assistant[TEXT]</s>" * 2
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "a", 576), ("audio", "b", 10), ("document", None, 1024)] and got["n_tokens"] == 3 + 576 + 10 + 1024
    own = op4_chat_format(spark, sf).where("conv_id = -7").head()
    text = "</s>[INST] ok [/INST]"
    assert own["n_turns"] == 2 and own["loss_chars"] == len(text) and own["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["É", "ß", "the"] * 5
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(25)]
    items += [(100, "alpha BÉTA"), (101, "alpha béta"), (102, "Solo"), (103, None), (104, "a " * 15), (105, "..."), (100, "alpha BÉTA")]
    texts = [*HARD, "Alpha Béta x", "x alpha béta, z " * 3, "solo", "a " * 20]
    for _ in range(60):
        own = rng.choice(items[:25])[1].split()
        a = rng.randrange(len(own))
        texts.append("; ".join([rng.choice(words) for _ in range(rng.randrange(30))] + own[a : a + rng.randrange(40)] + [rng.choice(words) for _ in range(rng.randrange(30))]))
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    windows = collections.defaultdict(set)
    for i, t in items:
        w = find((t or "").translate(LOWER))
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(str(i))
    want = []
    for i, t in enumerate(texts):
        w, hit, own = find((t or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    own |= windows[tuple(w[s : s + k])]
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(contamination(docs, bench), *columns) == want
    assert rows(contamination(docs, bench.limit(0)).where("n_hit > 0")) == [] and contamination(docs, bench.limit(0)).count() == len(texts)
    assert rows(contamination(docs.limit(0), bench)) == []
    plan = contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def toxic_table(spark, n=900):
    rng, bad = random.Random(8), ["grumblefist", "wormbrain", "slimewit"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "der", "les", "los"]) + rng.choice("abcdefghij") * 2 for _ in range(rng.randrange(5, 200))]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad).upper()
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    got = X.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.97


def test_toxicity_of_little(spark):
    docs, labels = toxic_table(spark, 30)
    assert len(rows(X.toxicity(documents(spark, HARD), labels.limit(0)))) == len(HARD)
    assert rows(X.toxicity(docs.limit(0), labels)) == []
    got = rows(X.toxicity(documents(spark, HARD, [None] * 2 + list(range(8))), labels.unionByName(spark.createDataFrame([(None, 1), (2, None), (2, 1)], labels.schema))))
    assert len(got) == len(HARD) and all(0 <= r[2] <= 1 for r in got)


def test_language_of_text():
    own = pa.array(["the cat of that", "der Hund und das", "les chats et une", "el perro y los", "zzz", None])
    assert [X.LANGS[i] for i in X.language_of(own)] == ["en", "de", "fr", "es", "other", "other"]


def test_pipeline_stages(spark, tmp_path):
    docs, labels = toxic_table(spark, 300)
    rng = random.Random(9)
    item = " ".join(f"q{i}" for i in range(40))
    long = " ".join(f"w{rng.randrange(1000)}" for _ in range(200))
    extra = documents(spark, ["Copy me", "copy ME", long, long + " more", item + " and a few", "clean text", "clean text"], [10_000, 10_001, 10_002, 10_003, 10_004, 10_005, 10_005])
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r["doc_id"] for r in now.where("doc_id >= 10000").collect())
    assert kept == {
        "toxicity": [10_000, 10_001, 10_002, 10_003, 10_004, 10_005, 10_005],
        "exact_dedup": [10_001, 10_002, 10_003, 10_004, 10_005],
        "near_dedup": [10_001, 10_002, 10_004, 10_005],
        "decontamination": [10_001, 10_002, 10_005],
    }
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    left = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "toxicity")).collect()}
    assert len(left & toxic) <= 3 and len(left) >= 200
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in now.collect()}


def test_contamination_where_lower_case_follows_context(spark):
    docs = documents(spark, ["ΛΟΓΟΣ's", "x ΛΟΓΟΣ s y", "λογοσ s"])
    items = spark.createDataFrame([("a", "ΛΟΓΟΣ s"), ("b", "ΛΟΓΟΣ.s")], "item_id string, text string")
    assert rows(contamination(docs, items), "doc_id", "n_hit", "n_items") == [(0, 2, 2), (1, 2, 2), (2, 0, 0)]


def brute_contamination(texts, items):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    windows = collections.defaultdict(set)
    for i, t in items:
        w = find((t or "").translate(LOWER))
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(i)
    out = []
    for i, t in enumerate(texts):
        w, hit, own = find((t or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    own |= windows[tuple(w[s : s + k])]
        out.append((i, len(w), len(hit), len(own)))
    return out


def test_contamination_of_letters_with_more_than_one_lower_case(spark):
    rng = random.Random(14)
    parts = ["ΑΣ", "ας", "ασ", "Σ", "ς", "İ", "i̇", "I", "ı", "K", "k", "K", "ß", "ẞ", "a", "A", "1", "_", "'", ".", ":", " ", " ", "-", "\n", "é", "É"]
    draw = lambda n: "".join(rng.choice(parts) for _ in range(rng.randrange(n)))
    items = [("a", "ΑΣ Α"), ("b", "ΑΣ ΒΓ"), *((f"r{k}", draw(12)) for k in range(30))]
    texts = ["ΑΣ'Α", "ΑΣ.ΒΓ", *(draw(60) for _ in range(200))]
    got = rows(contamination(documents(spark, texts), spark.createDataFrame(items, "item_id string, text string")), "doc_id", "n_words", "n_hit", "n_items")
    assert got == brute_contamination(texts, items) and got[0][2:] == (2, 1)


def test_contamination_by_items_that_share_a_template(spark):
    rng = random.Random(15)
    template = [f"t{k}" for k in range(20)]
    items = [(f"i{k}", " ".join([*template, f"x{k}", *(f"y{k % 3}" for _ in range(3)), *template[:15]])) for k in range(40)]
    texts = [" ".join(template), " ".join(template[3:16]), " ".join(template[3:15]), items[7][1], " ".join(i[1] for i in items), *(" ".join(rng.choice(items)[1].split()[rng.randrange(20) :]) for _ in range(20))]
    got = rows(contamination(documents(spark, texts), spark.createDataFrame(items, "item_id string, text string")), "doc_id", "n_words", "n_hit", "n_items")
    assert got == brute_contamination(texts, items) and got[0][3] == 40


def test_pipeline_of_nothing_and_of_hard_rows(spark, tmp_path):
    """Null texts and ids, an empty table, rows that repeat, columns named as operators name theirs."""
    hard = documents(spark, [*HARD, *HARD, "x y z"], [*range(len(HARD)), *range(len(HARD)), None])
    for name, own in (("hard", hard), ("none", hard.limit(0))):
        own.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(0, 0), (1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([(1, "a b c d e"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    got = corpus_pipeline.run(spark, str(tmp_path / "hard")).collect()
    kept = sorted((r["doc_id"] for r in got if r["start"] == 0), key=lambda x: (x is not None, x))
    # Of equal texts the last one stays, of rows that repeat one; "a b c d e" is the benchmark.
    norm = [(t or "").translate(LOWER) for t in HARD]
    want = [max(i for i, u in enumerate(norm) if u == t) for t in dict.fromkeys(norm) if t != "a b c d e"]
    assert kept == [None, *sorted(want)]


def test_a_row_is_not_lost_by_another_with_its_hash(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "row_key", lambda: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d")], "doc_id long, text string")
    gone = spark.createDataFrame([(2, 7), (None, 7)], "doc_id long, row_key long")
    assert rows(corpus_pipeline._joined(docs, gone, "left_anti"), "doc_id") == [(1,), (3,)]
    decisions = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 7, True), (3, 7, True), (None, 7, True)], "doc_id long, row_key long, kept boolean")
    assert rows(corpus_pipeline._one_of_each(docs.unionByName(docs.where("doc_id = 3")), decisions), "doc_id") == [(None,), (1,), (3,)]


def test_chat_round_trip_over_parts(spark):
    """Texts split anywhere, with placeholders between: no split makes a control string, and no placeholder is learned."""
    rng = random.Random(21)
    pieces = ["</s>", "<s>", "[TEXT]", "[/INST]", "[IMAGE]", "[AUDIO]", "\\", "<", "/s>", "[", "IMAGE]", "a", "é", "\n", "$1"]
    data, want = [], {}
    for c in range(80):
        turns, text, loss = [], "", ""
        for t in range(rng.randrange(1, 4)):
            role, parts, own = rng.choice(["user", "assistant"]), [], ""
            for _ in range(rng.randrange(7)):
                if rng.random() < 0.3:
                    kind = rng.choice(["image", "audio", "document"])
                    parts.append((kind, None, f"r{c}", None))
                    own += "\0" + kind
                else:
                    x = "".join(rng.choice(pieces) for _ in range(rng.randrange(4)))
                    cut = rng.randrange(len(x) + 1)
                    parts += [("text", x[:cut], None, None), ("text", x[cut:], None, None)]
                    own += x
            turns.append((c, t, role, parts))
            text += role + "\n" + own + "\n"
            loss += re.sub("\0(image|audio|document)", "", own) if role == "assistant" else ""
        data += turns
        want[c] = (len(turns), text, loss, sum(p[0] != "text" for t in turns for p in t[3]))
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    made = C.format_conversations(df)
    back = {r["conv_id"]: r for r in C.read_back(made).collect()}
    whole = {r["conv_id"]: r for r in made.collect()}
    for c, (n, text, loss, holes) in want.items():
        turns = back[c]["turns"]
        assert len(turns) == n and "".join(back[c]["learned"]) == loss and len(whole[c]["attachments"]) == holes
        plain = re.sub("\0(image|audio|document)", lambda m: C.PLACEHOLDERS[m[1]], text)
        assert "".join(f"{t['role']}\n{t['text']}\n" for t in turns) == plain
        at = 0  # the mask alone: learned characters are text, the others placeholders
        for t, mask in zip(re.findall(r".*?</s>", whole[c]["formatted"], re.DOTALL), whole[c]["mask"], strict=True):
            at = mask["start"]
            for r in mask["runs"]:
                assert not re.search(r"(?<!\\)" + C.HOLE, t[at : at + r["text"]]) and (not r["hole"] or re.fullmatch(C.HOLE, t[at + r["text"] :][: r["hole"]]))
                at += r["text"] + r["hole"]
            assert t[at:] == "</s>"


def test_tokens_by_a_rule(spark):
    df = spark.createDataFrame([(1, 0, "user", [("text", "it's 12, ok?", None, None), ("image", None, "x", None)])], f"conv_id long, turn long, role string, parts array<{C.PART}>")
    assert C.format_conversations(df, C.pretokens).head()["n_tokens"] == 8 + 576


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><div class='intro-banner'>" + "Many words, of the article. " * 20 + "</div></article>", ("Many words, of the article. " * 20).strip()),
        ("<article><h1>T</h1><p>Short, text.</p><div class='banner'>" + "Many words, of the article. " * 20 + "</div></article>", "T\nShort, text.\n" + ("Many words, of the article. " * 20).strip()),
        ("<div class='cookie-notice'>We use cookies, and that is all.</div>", ""),
        ("<body><div><h1>Title</h1><p>A lead, in a sentence.</p><div class=body><p>" + "The text, in many sentences. " * 9 + "</p><p>" + "More of it, here. " * 9 + "</p></div></div></body>", "Title\nA lead, in a sentence.\n" + ("The text, in many sentences. " * 9).strip() + "\n" + ("More of it, here. " * 9).strip()),
        ('<article><h1>T</h1><p>One, and more of it.</p><h2 id="discussion">Discussion</h2><p>Two, and more of it.</p></article>', "T\nOne, and more of it.\nDiscussion\nTwo, and more of it."),
    ],
)
def test_marks_are_a_second_vote(page, want):
    assert G.main_text(page) == want


PAGES = {
    "deep": "<div>" * 100_000 + "x, y. z", "paragraphs": "<p>" * 100_000 + "x", "unmatched ends": "<b>" * 100_000 + "x" + "</i>" * 100_000, "ends behind a block": "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
    "no ends": "<a " * 200_000, "an open quote": "<a " * 100_000 + "'>", "signs": "<" * 200_000, "marked": "<div class=ad>" * 50_000 + "text, here.", "many children": "<div>" + "<div><a>x</a></div>" * 50_000 + "</div>", "items": "<ul>" + "<li>x" * 100_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_long_and_deep_pages_take_linear_time(name):
    import time

    began = time.process_time()
    G.main_text(PAGES[name])
    assert time.process_time() - began < 6


def test_a_deep_page_takes_little_memory():
    import tracemalloc

    tracemalloc.start()
    assert G.main_text(PAGES["deep"]) == "x, y. z"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6


def test_content_nodes_equal_sums_by_path():
    rng = random.Random(23)
    tags = ["div", "p", "span", "a", "li", "section", "b"]

    def build(depth):
        out = ""
        for _ in range(rng.randrange(1, 4)):
            if depth and rng.random() < 0.7:
                tag = rng.choice(tags)
                out += f"<{tag}>{build(depth - 1)}</{tag}>"
            else:
                out += " ".join(rng.choice(["word", "two.", "a, b", "x!"]) for _ in range(rng.randrange(1, 9)))
        return out

    for _ in range(200):
        page = G.Page(build(5))

        def path(e, page=page):
            return (*path(page.elements[e].parent), page.elements[e].tag) if e > 0 else ()

        texts = page.texts
        per = collections.defaultdict(lambda: [0, 0, set()])
        for e, _, t in texts:
            own = per[path(e)]
            own[2].add(e)
            if "a" not in path(e):
                own[0] += len(t.strip())
                own[1] += len(re.findall(r"[.,;:!?]", t))
        ratio = [[per[path(e)][k] / len(per[path(e)][2]) for e, _, _ in texts] for k in (0, 1)]

        def smooth(values):
            out = []
            for i in range(len(values)):
                near = [(values[j], np.exp(-((i - j) ** 2) / 2)) for j in range(max(0, i - G.RADIUS), min(len(values), i + G.RADIUS + 1))]
                out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
            return np.array(out)

        fused = smooth(ratio[0]) * (1 + smooth(ratio[1]))
        want = (fused >= G.SHARE * fused.mean()) & (fused > 0)
        close = np.abs(fused - G.SHARE * fused.mean()) < 1e-9
        assert ((G.content_nodes(page, texts) == want) | close).all()
