"""The corpus pipeline's stages run together, against a plain version of all of them."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pulse.llm.packing import END_ID

WINDOW = 2048


def plain(docs, toxic):
    """(doc_id, text) of what the stages before packing keep; ``toxic``: ids known to be toxic."""
    docs = [d for d in docs if d[0] not in toxic]
    pages, on = Counter(s for _, _, s in docs), Counter()
    for _, text, source in docs:
        on.update({(source, x.strip()) for x in (text or "").split("\n") if x.strip()})
    bad = {k for k, n in on.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    docs = [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip()) not in bad)) for i, t, s in docs]

    sets = []
    for i, text in docs:
        words = (text or "").lower().split()
        sets.append({tuple(words[k:k + 5]) for k in range(len(words) - 4)})
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, docs, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [d for g, d in zip(group, docs, strict=True) if d[0] is None or d[0] == least[g]]


def test_stages_together(spark, tmp_dir):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "garden river stone winter letter music paper silver".split() for b in ("", "s", "ed", "ing", "ly")]

    def words(n):
        return " ".join(rng.choices(vocabulary, k=n))

    docs, toxic = [], set()
    for i in range(60):
        source = ("news", "blog", None)[i % 3]
        lines = [words(rng.randint(12, 40)) for _ in range(3)]
        if i % 3 == 0:
            lines.insert(rng.randint(0, 3), "  subscribe to our daily letter today please ")
        docs.append((i, "\n".join(lines), source))
    for i in range(60, 68):                                # near copies, of which some hold a boilerplate line
        text = docs[(i - 60) * 2][1].split("\n")
        docs.append((i, "\n".join([*text, "subscribe to our daily letter today please"] if i % 2 else [*text[:-1], text[-1] + " end"]), "news"))
    for i in range(68, 74):                                # toxic ones, some of which would be the smallest of their group or boilerplate
        docs.append((i, "you idiot, you moron, you scum\nonly toxic pages say this line", "blog"))
        toxic.add(i)
    for i in range(74, 78):
        docs.append((i, words(20) + "\nonly toxic pages say this line", "blog"))
    docs += [docs[5], docs[5], docs[70], (80, None, "news"), (81, "", None), (80, None, "news"), (82, words(3_000), "news")]
    long = docs[-1][1]
    docs += [(83, long + " more", "blog"), (84, "subscribe to our daily letter today please", "news")]
    rng.shuffle(docs)
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")

    kept = plain(docs, toxic)
    ids = {i for i, _ in kept}
    assert not ids & (toxic | set(range(60, 68)) | {83}) and {80, 81, 82, 84} | set(range(74, 78)) <= ids
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, text in kept:
        tokens = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        for at in range(0, len(tokens), WINDOW):
            part = np.array(tokens[at:at + WINDOW], "<u4").tobytes()
            want[i, at, len(part) // 4, zlib.crc32(part), len(tokens)] += 1
    rows = corpus_pipeline.run(spark, tmp_dir).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in spans.values():
        ends = [0] + [o + n for o, n in sorted(placed)]
        assert [o for o, _ in sorted(placed)] == ends[:-1] and ends[-1] <= WINDOW
    sizes = [sum(n for _, n in placed) for placed in spans.values()]
    assert sum(a + b <= WINDOW for k, a in enumerate(sizes) for b in sizes[:k]) == 0    # no two windows fit in one


def test_empty_table_clashing_columns_and_a_very_long_text(spark, tmp_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shingle string, score string, host string, ids string, component string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    empty = spark.createDataFrame([], schema)
    long = " ".join(f"w{k * k % 99991}" for k in range(60_000))
    rows = [(1, long, None, None, None, "a", "b", "c", "d", "e"), (2, long + " end", "en", "s", 1, None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "x", "x", "x", "x", "x")]
    full = spark.createDataFrame(rows, schema)
    for docs, n in ((empty, 0), (full, 3)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, tmp_dir)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() == n
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, tmp_dir).collect()
        assert {r.doc_id for r in packed} == ({1, 3, None} if n else set())
