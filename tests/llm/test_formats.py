"""Chat templates, Ogg media, sharding, source mixing and the pipeline."""

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strataq.llm import chat_template as ct
from strataq.llm import ogg_media, sharding, source_mix


def test_escape_round_trip():
    rng = random.Random(2)
    bits = ["\\", "<", "</", "turn>", "<turn>", "</turn>", "<says>", "<end>", "\n", "a", "é", "\\\\"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))
        e = ct.escape(t)
        assert ct.unescape(e) == t and not any(c in e for c in ct.CONTROLS)


def test_template_language():
    render = ct.compile_template("{% set x = 'a' ~ 1 %}{# no #}{{ x | upper }}{% for m in messages %}{{ loop.index }}{% if m.role == 'user' and not loop.last %}U{% elif m['role'] in 'system' %}S{% else %}{% generation %}{{ m.text | default('?') | trim }}{% endgeneration %}{% endif %};{% endfor %}")
    text, spans = render([{"role": "user", "text": "q"}, {"role": "system"}, {"role": "assistant", "text": " hi "}])
    assert text == "A11U;2S;3hi;" and [text[a:b] for a, b in spans] == ["hi"]


def test_constants_are_folded():
    tree = ct.fold(ct.parse("a{{ 'b' ~ 2 }}{% if 1 == 2 %}x{% elif true %}c{% else %}y{% endif %}{{ 'd' | upper }}"))
    assert tree == ("block", ("text", "ab2cD"))


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{{ a( }}", "{{ a | eval }}", "{% if a %}", "{% endif %}", "{{ 'a' 'b' }}", "{% include 'x' %}", "{{ }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"])
def test_bad_templates_are_refused(bad):
    with pytest.raises(ct.TemplateError):
        ct.compile_template(bad)


def test_sandbox_reaches_no_python_attributes():
    with pytest.raises(ct.TemplateError):
        ct.compile_template("{{ messages.__class__ }}")([{"role": "a"}])
    assert ct.compile_template("{{ messages[0].__class__ }}")([{"role": "a"}])[0] == ""


def test_chat_columns(spark):
    rows = [(1, 1, "assistant", "B </turn>", 0), (1, 0, "user", None, 0), (2, 0, None, "", 0), (2, 0, None, "", 0), (3, 5, "us<says>er", "\\### Assistant: </turn> ok", 0), (None, 0, "assistant", "x" * 200_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    done = ct.format_conversations(ct.conversations(df))
    out = {r.conv_id: r for r in done.withColumn("r", ct.parse_formatted(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t.role, t.text) for t in out[1].r.turns] == [("user", ""), ("assistant", "B </turn>")] and out[1].r.loss == ["B </turn>"]
    assert [(t.role, t.text) for t in out[2].r.turns] == [("", "")] * 2 and out[2].r.loss == []
    assert [(t.role, t.text) for t in out[3].r.turns] == [("us<says>er", "\\### Assistant: </turn> ok")]
    assert out[None].r.loss == ["x" * 200_000]
    assert ct.format_conversations(ct.conversations(df.filter("false"))).collect() == []


def test_each_conversation_is_formatted_once(spark):
    """The optimizer once copied the formatting into each use of its result: three workers of a task, three lists of each conversation."""
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    done = ct.format_conversations(ct.conversations(df))
    back = done.select("conv_id", F.length("formatted"), ct.parse_formatted(F.col("formatted"), F.col("loss_spans")).alias("r"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def plain_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg_crc_and_layout():
    data = random.Random(1).randbytes(700)
    assert ogg_media.page_crc(data) == plain_crc(data)
    media = ogg_media.mux(ogg_media.pad(b"abc"))
    assert media[:4] == b"OggS" and media[5] == ogg_media.FIRST
    n = media[26]
    page = media[: 27 + n + sum(media[27 : 27 + n])]
    assert struct.unpack_from("<I", page, 22)[0] == plain_crc(page[:22] + b"\0\0\0\0" + page[26:])


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 3999, 4000, 4001, 8000, 12_001, 65_025, 255 * 255, 400_000])
def test_ogg_round_trip(size):
    payload = ogg_media.pad(random.Random(size).randbytes(size))
    m = ogg_media.demux(ogg_media.mux(payload))
    assert m.payload == payload and m.streams == 2 and len(payload) % 192 == 0
    assert [t for _, t, _ in m.packets] == [k * ogg_media.PACKET / m.rate for k in range(len(m.packets))]
    assert len({s for s, *_ in m.packets}) == min(2, len(m.packets))


def test_ogg_damage_is_found():
    media = ogg_media.mux(ogg_media.pad(random.Random(3).randbytes(200_000)))
    rng = random.Random(4)
    for _ in range(60):
        k = rng.randrange(len(media))
        with pytest.raises(ogg_media.OggError):
            ogg_media.demux(media[:k] + bytes([media[k] ^ (1 << rng.randrange(8))]) + media[k + 1 :])
        with pytest.raises(ogg_media.OggError):
            ogg_media.demux(media[: rng.randrange(len(media))])
    for bad in (b"", b"OggS", media + media):
        with pytest.raises(ogg_media.OggError):
            ogg_media.demux(bad)


def test_media_columns(spark):
    texts = [None, "", "é" * 100, "x" * 300_000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 as MEDIA", "2 as feature")
    out = {r.doc_id: r for r in ogg_media.decode_media(ogg_media.encode_media(df)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert out[k].n_bytes == len(raw) and bytes(out[k].payload) == ogg_media.pad(raw)
    assert out[4].media == out[5].media and out[4].feature == out[5].feature and out[0].media == out[1].media
    broken = spark.createDataFrame([(bytearray(b"junk"),), (None,)], "media binary")
    assert [r.payload for r in ogg_media.decode_media(broken, on_error="null").collect()] == [None, None]
    assert ogg_media.decode_media(ogg_media.encode_media(df.filter("false"))).collect() == []


def jump(key, n):
    """The published algorithm."""
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_algorithm(spark):
    rng = random.Random(6)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(300)), *range(100)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100, 1000):
        got = [r[0] for r in df.select(sharding.jump_shard("k", n)).collect()]
        assert got == [jump(k, n) for k in keys], n


@pytest.mark.parametrize("per_bucket", [50_000, 3])
def test_sharded_rows(spark, per_bucket):
    rows = [(k, f"t{k % 7}", "s") for k in range(400)] + [(5, "t5", "s")] * 60 + [(None, None, "x"), (None, "a", "y"), (7, "other", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    out = sharding.shard_rows(df, "doc_id", 8, {"size": "cast(coalesce(octet_length(text), 0) + 1 as bigint)", "text_crc32": "crc32(cast(coalesce(text, '') as binary))"}, per_bucket).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((k is None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.shard == jump(r.doc_id or 0, 8) and r.grown_shard in (r.shard, 8) for r in out)
    assert sharding.shard_rows(df.filter("false")).collect() == []
    plan = sharding.shard_rows(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_raking_meets_all_margins(spark):
    rng = random.Random(8)
    cells = [(s, lang, t, rng.randrange(1, 5000) * (40 if s == "s0" else 1)) for s in ("s0", "s1", "s2", "") for lang in ("en", "de") for t in ("a", "b", "c")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, n_tokens long")
    targets = {"source": {"s0": 1, "s1": 1, "s2": 1, "": 1}, "lang": {"en": 3, "de": 1}, "topic": {"a": 2, "b": 1, "c": 1}}
    out = source_mix.rake(df, {}, targets, 30).collect()
    for m, goal in targets.items():
        for v, share in goal.items():
            assert abs(sum(r.weight for r in out if r[m] == v) - share / sum(goal.values())) < 1e-6
    kept = source_mix.rake(df, dict.fromkeys(source_mix.MARGINS, 1.0)).collect()
    total = sum(c[3] for c in cells)
    assert all(abs(sum(r.weight for r in kept if r.source == s) - sum(c[3] for c in cells if c[0] == s) / total) < 1e-6 for s in ("s0", "s1"))


def test_mix_samples_by_its_probabilities(spark):
    rng = random.Random(9)
    rows = [(k, "x" * rng.randrange(0, 3000), rng.choice(["en", "de", None]), "hot" if k % 3 == 0 else f"s{k % 9}", "c") for k in range(6000)] + [(7, None, "en", "hot", "c"), (None, "abc", "en", None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string").repartition(4)
    out = source_mix.mix(df, 0.4)
    got = out.collect()
    assert all(int(hashlib.md5(str(r.doc_id).encode() if r.doc_id is not None else r.text.encode()).hexdigest()[:12], 16) / 2**48 < r["__p"] for r in got)
    total = sum(max(1, (len(r[1] or "") + 3) // 4) for r in rows)
    assert 0.35 < sum(r["__tokens"] for r in got) / total < 0.45
    hot = sum(r["__tokens"] for r in got if r.source == "hot") / sum(r["__tokens"] for r in got)
    assert hot < 0.33
    assert source_mix.mix(df.filter("false")).collect() == []
    assert "Python" not in out._jdf.queryExecution().toString()


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select(*cp.COLUMNS)
    odd = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "123 456", "en", "src0", 7), (None, "The and of", None, None, 10)], docs.schema)
    docs = docs.unionByName(odd)
    first = cp.identify_language(spark, docs, d)
    ids = {r.doc_id for r in first.collect()}
    assert -1 not in ids and -2 not in ids and len(ids) >= docs.count() - 8
    second = cp.drop_toxic(spark, first, d).cache()
    assert second.columns == list(cp.COLUMNS)
    rows = second.select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w and r.doc_id is not None else set()
    part = {k: k for k in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    keys = [k for k in sets if sets[k]]
    for a in keys:
        for b in keys:
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    third = cp.drop_near_duplicates(spark, second, d).cache()
    assert {r.doc_id for r in third.collect()} == {k for k in sets if k is None or find(k) == k}
    fourth = cp.mix_sources(spark, third, d).cache()
    assert 0 < fourth.count() <= third.count() and fourth.columns == list(cp.COLUMNS)
    last = cp.encode(spark, fourth, d)
    assert last.count() == fourth.count() and last.filter("n_tokens < 1").count() == 0


def test_pipeline_drops_toxic_and_keeps_clean(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select(*cp.COLUMNS)
    left = {r.doc_id for r in cp.drop_toxic(spark, docs, d).select("doc_id").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    bad, good = [{k for k, y in marks.items() if y == v} for v in (1, 0)]
    assert len(good & left) >= 0.99 * len(good) and len(bad & left) <= 0.4 * len(bad)


def test_near_duplicates_go_by_text_not_by_id(spark):
    import corpus_pipeline as cp

    def text(k):
        return " ".join(f"t{k}w{j}" for j in range(60))

    rows = [(1, text(1)), (2, text(2)), (3, text(3)), (5, text(1)), (5, text(4)), (5, text(5)), (5, text(5)), (6, text(5)), (6, text(6)), (7, text(6) + " more"), (2, text(7)), (9, text(2).upper())]
    rows += [(100, text(200 + k)) for k in range(30)] + [(100, text(3))] + [(None, text(8)), (None, text(8)), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, "").collect()]
    gone = [(5, text(1)), (6, text(5)), (7, text(6) + " more"), (9, text(2).upper()), (100, text(3)), (5, text(5))]
    want = list(rows)
    for x in gone:
        want.remove(x)
    assert sorted(kept, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("fraction", [0.5, 0.6])
def test_mix_meets_budget_and_shares_with_full_cells(spark, fraction):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    cells = source_mix.cell_table(source_mix.categorised(docs)).cache()
    rated = source_mix.rates(cells, fraction, source_mix.TEMPER)
    rows = rated.collect()
    total = sum(r.n_tokens for r in rows)
    assert any(r.p == 1 for r in rows) and all(0 < r.p <= 1 for r in rows)
    assert abs(sum(r.n_tokens * r.p for r in rows) / total - fraction) < 1e-6
    out = [(r.margin, r.value, r.target, r.achieved) for r in source_mix.report(rated).collect()]
    room = {(m, v): sum(r.n_tokens for r in rows if r[m] == v) / (fraction * total) for m, v, _, _ in out}
    for m in source_mix.MARGINS:
        mine = [x for x in out if x[0] == m]
        goal = {v: t for _, v, t, _ in mine}
        free = set(goal)
        while any(goal[v] > room[m, v] + 1e-12 for v in free):  # values without enough tokens are kept whole, the others share the rest
            goal |= {v: room[m, v] for v in free if goal[v] > room[m, v]}
            free -= {v for v in free if goal[v] == room[m, v]}
            rest, held = 1 - sum(goal[v] for v in goal if v not in free), sum(goal[v] for v in free)
            goal |= {v: goal[v] * rest / held for v in free}
        assert all(abs(got - goal[v]) < 1e-5 for _, v, _, got in mine)
    sample = source_mix.mix(docs, fraction).collect()
    for m, v, _, share in out:  # four standard deviations, estimated from the sample
        mine = [r for r in sample if r[f"__{m}"] == v]
        spread = sum(r["__tokens"] ** 2 * (1 - r["__p"]) for r in mine) ** 0.5
        assert abs(sum(r["__tokens"] for r in mine) - share * fraction * total) <= 4 * spread + 1


@pytest.mark.parametrize("packet", [1, 254, 255, 500, 8000, 100_000])
def test_ogg_packet_lengths_are_read_from_the_stream(packet):
    payload = ogg_media.pad(random.Random(packet).randbytes(3000))
    m = ogg_media.demux(ogg_media.mux(payload, packet=packet))
    assert m.payload == payload and sum(n for *_, n in m.packets) == len(payload)
    with pytest.raises(ogg_media.OggError):
        ogg_media.mux(payload, packet=0)


def test_template_trims_white_space():
    assert ct.compile_template("a  {%- if true -%}  b  {% endif %} c {{- 'd' -}} \n e {#- x -#} f")([])[0] == "ab   cdef"


@pytest.mark.parametrize("bad", ["{{ 1 + 'a' }}", "{{ none | length }}", "{{ 'a' < 1 }}", "{{ 1 in 2 }}"])
def test_constants_of_wrong_kinds_are_template_errors(bad):
    with pytest.raises(ct.TemplateError):
        ct.compile_template(bad)


def test_values_of_wrong_kinds_are_template_errors():
    for bad in ("{{ messages + 1 }}", "{% for x in 'ab' %}{% endfor %}", "{{ missing | length }}"):
        with pytest.raises(ct.TemplateError):
            ct.compile_template(bad)([{"role": "a"}])


def test_chat_column_clashes_and_no_turns(spark):
    df = spark.createDataFrame([(1, [], "x", "y"), (2, None, "x", "y")], "conv_id long, turns array<struct<turn:long,role:string,text:string>>, Formatted string, __f string")
    out = ct.format_conversations(df)
    assert out.columns == ["conv_id", "turns", "__f", "formatted", "loss_spans"]
    assert {(r.conv_id, r.formatted, r["__f"]) for r in out.collect()} == {(1, "<end>", "y"), (2, "<end>", "y")}


def test_shards_keep_columns(spark):
    rows = [(k % 40, f"t{k % 3}", None if k % 5 else k) for k in range(200)] + [(None, None, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, more long").repartition(3)
    out = sharding.shard_rows(df, "doc_id", 4, None, 10).collect()
    assert sorted(((r.doc_id, r.text, r.more) for r in out), key=str) == sorted(rows, key=str)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_rows(df.withColumnRenamed("more", "Slot")).columns == ["doc_id", "text", "shard", "slot", "grown_shard"]
    with pytest.raises(ValueError):
        sharding.shard_rows(df.withColumnRenamed("doc_id", "shard"), "shard")
    with pytest.raises(ValueError):
        sharding.shard_rows(df, "doc_id", 8, {"slot": "1"})


def test_mix_with_clashing_columns(spark):
    rows = [(k, "x" * (k % 50), "en", f"s{k % 3}", 1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __P int, __draw int")
    out = source_mix.mix(df, 0.5)
    assert out.columns == ["doc_id", "text", "lang", "source", "__draw", "__source", "__lang", "__topic", "__tokens", "__p"]
    assert 0 < out.count() < 300 and {r["__draw"] for r in out.collect()} == {2}


def test_mix_by_given_targets_and_by_shuffled_margins(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, "x" * rng.randrange(2000), rng.choice(["en", "de"]), f"s{rng.randrange(4)}") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = source_mix.cell_table(source_mix.categorised(df))
    targets = {"source": {"s0": 2, "s1": 1, "s2": 1}}
    one = {(r.source, r.lang, r.topic): r.p for r in source_mix.rates(cells, 0.3, source_mix.TEMPER, targets).collect()}
    assert {s for s, *_ in one} == {"s0", "s1", "s2"}
    got = {r.value: (r.wanted, r.achieved) for r in source_mix.report(source_mix.rates(cells, 0.3, source_mix.TEMPER, targets)).filter("margin = 'source'").collect()}
    assert all(abs(a - w) < 1e-6 for w, a in got.values()) and abs(sum(w for w, _ in got.values()) - 1) < 1e-9
    for few in (0, 1):  # no table in one partition; no margin (or only those of one value) broadcast
        monkeypatch.setattr(source_mix, "FEW", few)
        monkeypatch.setattr(source_mix, "ROUNDS", 4 if few else 2)
        two = {(r.source, r.lang, r.topic): r.p for r in source_mix.rates(cells, 0.3, source_mix.TEMPER, targets).collect()}
        assert all(abs(one[k] - two[k]) < 1e-2 for k in one)


def test_pipeline_run_equals_its_stages(spark, tmp_path):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    done = cp.run(spark, d)
    assert done.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    docs = spark.read.parquet(f"{d}/documents.parquet").select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, d)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(map(str, done.collect())) == sorted(map(str, docs.collect())) and done.count() > 20
    empty = str(tmp_path / "none")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").filter("false").write.parquet(f"{empty}/{name}.parquet")
    assert cp.run(spark, empty).collect() == []
