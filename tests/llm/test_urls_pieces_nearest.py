import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from shelfsight.llm.nearest import nearest
from shelfsight.llm.pieces import ChunkTable, piece_digests, piece_ids, read_model
from shelfsight.llm.queries import URL_RULES
from shelfsight.llm.url_filter import judge_urls

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path.split("?")[0].split("#")[0] if path and path[0] == "/" else ""
    fit = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fit)[2], max(fit)[1]) if fit else (None, "allow"))


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    rules = [*URL_RULES, ("allow", "a.example.org", "/es/x"), ("block", "b.a.example.org", "/"), ("block", "net", "/")]
    hosts = ["Example.ORG", "a.example.org", "b.a.example.org", "c.b.a.example.org", "xexample.org", "org", "com", "q.com", "net", "", "example.org.", "fr"]
    urls = [f"{rng.choice(['http', 'x', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es/x1', '/en/12', '/fr/', '/de/3', '/es'])}{rng.choice(['', '?a=/es/', '#t', '/z?u#v'])}" for _ in range(400)] + [None, "", "example.org/es/", "://", "a://b://c/d"]
    rows = [(i, u, 9) for i, u in enumerate(urls)] + [(3, urls[3], 9)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host int"), rules).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i, h, p, r or "", v) for i, u, _ in rows for h, p, r, v in [brute_url(u, rules)])
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert judge_urls(spark.createDataFrame(rows, "page_id long, url string, host int"), []).where("verdict <> 'allow'").count() == 0


def test_pieces_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    table = ChunkTable(read_model(MODEL), table_rows=50)
    alphabet = list("  \n\t▁abcdeé中\U0001f600ßthe.,0123\u200b\u00a0\x00\r<>s") + ["the ", "   ", "<0x0A>", "</s>", "<unk>", "ation"]
    texts = ["", " ", "\n", "▁", "  a", "a  ", "<s>", *("".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(3000)), "x" * 5000, " " * 300, "ab " * 9000]
    for t in texts:
        ids = sp.encode(t)
        assert table.ids(t) == ids
        n, joined, decoded = table.encode(t)
        assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), sp.decode(ids) if ids else ""), repr(t)


def test_pieces_table(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b\nc", 5), (3, "a b\nc", 5)], "doc_id long, text string, n_tokens int")
    got = sorted(piece_digests(docs, MODEL).collect())
    assert [r.n_tokens for r in got][:2] == [0, 0] and got[2] == got[3] and got[0].ids_sha256 == got[1].decoded_sha256
    assert {r.doc_id: r.decoded for r in piece_ids(docs, MODEL).collect()} == {1: "", 2: "", 3: "a b\nc"}
    assert piece_digests(docs.limit(0), MODEL).count() == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)), 1)
    x[7] = x[11] = x[40]
    rows = [(i, [float(v) for v in r], "l") for i, r in enumerate(x)]
    rows += [(300, None, "n"), (301, [0.0] * 8, "z"), (302, [1.0] * 7 + [float("nan")], "n"), (303, [1.0] * 7 + [None], "n"), (304, [1.0], "short"), (7, rows[7][1], "again"), (None, rows[0][1], "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    for k, qb, b in ((20, 4096, 8192), (5, 7, 3), (400, 16, 64)):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("id") % 20 == 0, k=k, query_block=qb, block=b).collect())
        want = []
        for q in range(0, 300, 20):
            near = sorted((-sum(a * b for a, b in zip(x[q], x[c], strict=True)), c) for c in range(300) if c != q)[:k]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(near, 1)]
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert nearest(df.where("vec_id = 20"), F.col("id") % 20 == 0).count() == 0
