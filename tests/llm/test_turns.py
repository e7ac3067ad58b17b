"""Repair and formatting of conversations, and alignment of two tokenizers, against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from parley.llm import align, chat, lm, repair, tokens  # noqa: E402

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, key string, seq long, text_sha int, copy string"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(seed=3, n=160):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Fine.", "Fine.", "cut off", " \n", "", None, "a<|im_end|>b!", "é? ", "Yes!\n"])
            rows.append((c, rng.choice([t, t, t + 3, 1, None]), role, text))
    rows += [(None, 0, "user", "hello."), (None, 1, "assistant", "again.")] + [(900, 4, "user", "same.")] * 5
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "z") for r in rows], SCHEMA).repartition(3)


def after_damage(rows):
    out, mark = {}, lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        key, role, text = mark(c), mark(role), mark(text)
        kind = zlib.crc32(f"{key}:{mark(t)}".encode()) % 20
        out.setdefault(key, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[key] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    return out


def faults(own):
    out, seen = [], set()
    for _, role, text in own:
        bare = text.rstrip(SPACE)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def legal(initials, whole):
    body = initials.removeprefix("s")
    return (not initials or all(x == "ua"[k % 2] for k, x in enumerate(body))) and (not whole or not initials or (len(body) > 0 and len(body) % 2 == 0))


def cheapest(own):
    """All scripts with at most two insertions a gap, cut where the roles go wrong."""
    kinds, best = faults(own), None
    names = {"u": "user", "a": "assistant"}

    def go(i, cost, audit, turns):
        nonlocal best
        initials = "".join(r[:1] or "-" for r, _ in turns)
        if not legal(initials, False) or (best and cost > best[0]):
            return
        for more in ("", "u", "a", "ua", "au"):
            script, here = audit + "I" * len(more), [*turns, *((names[x], "") for x in more)]
            spent = cost + 3 * len(more)
            if i == len(own):
                if legal("".join(r[:1] or "-" for r, _ in here), True):
                    best = min(best or (1 << 30,), (spent, script, [f"{r}:{t}" for r, t in here]))
                continue
            _, role, text = own[i]
            go(i + 1, spent + 4, script + "D", here)
            if kinds[i] in (0, 3):
                extra = 3 * (kinds[i] == 3)
                go(i + 1, spent + extra, script + "K", [*here, (role, text)])
                for to in names.values():
                    go(i + 1, spent + 3 + extra, script + "R", [*here, (to, text)])

    go(0, 0, "", [])
    return best


def brute_repair(rows):
    out = {}
    for key, own in after_damage(rows).items():
        kinds, turns = Counter(faults(own)), [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = cheapest(own)
        out[None if key == " " else int(key)] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds[1], kinds[2], kinds[3], illegal, cost, audit, sha("\n".join(lines)))
    return out


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_repair_equals_all_scripts(spark):
    rows = conversations()
    assert by_id(repair.repair_report(frame(spark, rows))) == brute_repair(rows)


def test_repair_of_conversations_over_many_blocks(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", f"No {t}.", "cut", ""])) for c in range(3) for t in range(300)]
    turns = repair.damaged(frame(spark, rows))
    whole, parts = (repair.repaired(turns, size) for size in (1 << 16, 7))
    ids = frame(spark, rows).select("conv_id")
    assert by_id(repair.report(whole, ids)) == by_id(repair.report(parts, ids))
    lines = {}
    for r in sorted(repair.texts(parts).collect(), key=lambda r: (r["seq"], r["step"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: sha("\n".join(x)) for c, x in lines.items()} == {c: x[-1] for c, x in by_id(repair.report(parts, ids)).items()}


def test_walk_is_the_least_script_of_a_plain_program():
    rng = random.Random(2)
    for n in [1, 2, 3, 17, 100, 101]:
        codes = [rng.randrange(16) for _ in range(n)]
        best = {0: (0, "")}
        for code in codes:
            fault, kind = divmod(code, 4)
            new = {}
            for s, (cost, audit) in best.items():
                for _ in range(3):
                    options = [(s, cost + 4, audit + "D")]
                    if fault in (0, 3):
                        more = 3 * (fault == 3)
                        options.append((repair.NEXT[s], cost + 3 + more, audit + "R"))
                        if repair.KEEP[kind][s] >= 0:
                            options.append((repair.KEEP[kind][s], cost + more, audit + "K"))
                    for to, *x in options:
                        new[to] = min(new.get(to, (1 << 30, "")), tuple(x))
                    s, cost, audit = repair.NEXT[s], cost + 3, audit + "I"
            best = new
        cost, audit = min((c + repair.END[s], a + "I" * (repair.END[s] // 3)) for s, (c, a) in best.items())
        edits, _, _ = repair.walk(codes, list(repair.END), repair.EMPTY, True)
        assert "".join(edits) == audit
        assert repair.matrix(codes)[0][repair.EMPTY] >= cost


def test_repair_of_nothing(spark):
    assert repair.repair_report(frame(spark, [])).count() == 0
    gone = next(t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert by_id(repair.repair_report(frame(spark, [(5, gone, "user", "Hi.")]))) == {5: (0, 0, 0, 0, 0, 0, "", sha(""))}


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choices("<|\\\nan", k=rng.randint(0, 12)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        role = chat.escape_role(text)
        assert "<|" not in role and "\n" not in role and chat.unescape_role(role) == text


def test_chat_round_trip(spark):
    path = public_tokenizers.path(A)
    rows = [*conversations(5, 60), (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|endoftext|>"), (77, 0, "as\nsis<|tant", "<\\|x|>\\"), (78, 0, "assistant", "word " * 5000)]
    written = chat.formatted(frame(spark, rows), path)
    assert not any(b"<|im_" in b"".join(tokens.encoder(path).library.id_to_token(int(i)).encode() for i in np.frombuffer(r["ids"], "<u4") if i <= tokens.encoder(path).largest) for r in written.limit(20).collect())
    out, own = {}, {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        length = sum(12 + len(chat.escape_role(r)) + 1 + len(chat.escape(t)) + 11 for _, r, t in turns)
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learnt), sha(learnt), length)
    assert by_id(chat.digests(chat.read_back(written, path))) == out
    assert chat.digests(chat.read_back(chat.formatted(frame(spark, []), path), path)).count() == 0


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinsé", k=rng.randint(1, 9))) + rng.choice(["", ",", ".", "'s", "."]) for _ in range(n))


def texts():
    rng = random.Random(11)
    odd = [None, "", " ", "a", "  two", "end ", "x\n\n\ny", "a\nb c\nd", "▁ mark", "say <|endoftext|> now", "日本語 テスト。 한국어", "👍🏽 ok", "\ttab\r\nline", "é" * 300, "no break", "1234567 89", "\nfirst", "</s> <unk> <0x41>", "z" * 4000]
    return [*odd, *(prose(rng, rng.randint(1, 60)) for _ in range(40)), prose(rng, 4000)] + ["Same words again."] * 6


def brute_alignment(rows):
    import sentencepiece
    from parley.llm import vocabulary
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    of_a, of_b = vocabulary.byte_level(public_tokenizers.path(A)), vocabulary.pieces(public_tokenizers.path(B))
    held, counts = [], Counter()
    for text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(of_a[i] for i in x) != whole or b"".join(of_b[i] for i in y) != whole:
            x, y = [], []
        ends_x, ends_y = np.cumsum([0, *(len(of_a[i]) for i in x)]), np.cumsum([0, *(len(of_b[i]) for i in y)])
        pairs, j0 = [], 0
        for i in range(len(x)):
            while j0 < len(y) and ends_y[j0 + 1] <= ends_x[i]:
                j0 += 1
            j = j0
            while j < len(y) and ends_y[j] < ends_x[i + 1]:
                pairs.append((x[i], y[j]))
                j += 1
        common, parts = sorted(set(ends_x.tolist()) & set(ends_y.tolist())), []
        for low, high in zip(common, common[1:], strict=False):
            parts.append("|".join(",".join(str(ids[k]) for k in range(len(ids)) if low <= ends[k] < high) for ids, ends in ((x, ends_x), (y, ends_y))) if len(x) < 3000 else "")
        held.append((len(x), len(y), len(parts), pairs, sha(";".join(parts)) if x else ""))
        counts.update(set(pairs))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(n, m, g, len(p), sum(counts[q] == best[q[0]] for q in p), sum(counts[q] for q in p), h if n < 3000 else None) for n, m, g, p, h in held]


@pytest.mark.parametrize("known", [align.KNOWN, 20])
def test_alignment_equals_brute_force(spark, known):
    rows = list(enumerate(texts())) + [(3, "a"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, key int, n int, a string").repartition(3)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [(r["doc_id"], *(None if c == "groups_sha256" and r["n_a"] >= 3000 else r[c] for c in columns)) for r in align.alignment(docs, public_tokenizers.path(A), public_tokenizers.path(B), known).collect()]
    want = [(i, *w) for (i, _), w in zip(rows, brute_alignment([t for _, t in rows]), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert align.alignment(docs.limit(0), public_tokenizers.path(A), public_tokenizers.path(B)).count() == 0


def test_stretches_align_like_whole_texts():
    rng, own = random.Random(9), align.aligner(public_tokenizers.path(A), public_tokenizers.path(B))
    for _ in range(4_000):
        t = "".join(rng.choices(["a", "Ab", " ", " ", "\n", ".", "'s", "'", "é", "日", "7", "<|endoftext|>", "-", "​", "ſ"], k=rng.randint(1, 14)))
        cut = own.stretches(t)
        if cut is None:
            continue
        made = own.entries([t])[0]
        whole = own.align(own.a.encode(" " + t, add_special_tokens=False).ids, own.b.encode(t), (" " + t).encode())
        assert b";".join(own.texts[k] for k in made) == own.texts[whole], t
        assert sum(own.at[k + 1] - own.at[k] for k in made) == own.at[whole + 1] - own.at[whole]


def test_lm_scores_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefg", k=4)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([200, 20_000])))) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs, key = spark.read.parquet(f"{tmp_path}/docs"), "spark.sql.execution.arrow.maxBytesPerBatch"
    before, out = spark.conf.get(key), []
    try:
        for size in ("64m", "300k"):
            spark.conf.set(key, size)
            out.append({r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.bloom_scores(docs).collect()})
    finally:
        spark.conf.set(key, before)
    assert sum(len(t) for _, t in rows) > 2 * lm.CHUNK and out[0] == out[1]
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.split(), "</s>"])
    n, v = sum(count.values()), len(count)
    for i, t in rows[:20]:
        base = sum(np.log10((count[w] + 1) / (n * 1 + 1 * (v + 1))) for w in [*t.split(), "</s>"])
        assert out[0][i][0] == len(t.split()) + 1 and out[0][i][2] == n and abs(out[0][i][3] - base) < 1e-4
