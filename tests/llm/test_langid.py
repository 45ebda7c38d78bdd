"""Language identification against the same filters kept as plain sets, text by text."""

import random
import re
import zlib

from brinegrid.llm import langid
from brinegrid.llm.scratch import fold

from .conftest import words


def grams(text):
    raw = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    raw = raw.ljust(4)
    return [raw[k : k + 4] for k in range(len(raw) - 3)]


def places(gram):
    x = int.from_bytes(gram, "little")
    out = []
    for turn in langid.TURNS:
        y = x * turn % 2**32
        out.append((y ^ y >> 15) * 0x27D4EB2F % 2**32 >> (32 - langid.SLOT_BITS))
    return out


def test_identification_equals_plain_sets(spark):
    rng = random.Random(4)
    kinds = {"aa": "abcde", "bb": "cdefgh", "cc": "mnopÄ"}
    texts = []
    for k in range(240):
        lang = rng.choice(list(kinds))
        texts.append((k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(1, 40))).title(), lang if k % 5 else None))
    texts += [(300, None, "aa"), (301, "", "aa"), (302, "12 34", "bb"), (303, "a", None), (304, words(rng, 3000), None), (305, texts[7][1], None), (306, texts[7][1], None), (307, "日本語 テスト", None)]
    docs = spark.createDataFrame(texts, "id bigint, text string, lang string").repartition(3)
    got = {r.id: (r.lang_pred, r.score) for r in langid.identify(docs.select("id", "text"), langid.fit(docs, fold("id", 3) != 1, "text", "lang")).collect()}
    learn = [(t, lang) for i, t, lang in texts if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    slots, chance = {}, {}
    for lang in kinds:
        own = [set(grams(t)) for t, x in learn if x == lang]
        count = {}
        for s in own:
            for g in s:
                count[g] = count.get(g, 0) + 1
        slots[lang] = {p for g, n in count.items() if n >= max(2, langid.RARE * len(own)) for p in places(g)}
        chance[lang] = (len(slots[lang]) / 2**langid.SLOT_BITS) ** len(langid.TURNS)
    for i, text, _ in texts:
        if not text or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        every = grams(text)
        share = {x: (sum(all(p in slots[x] for p in places(g)) for g in every) / len(every) - chance[x]) / (1 - chance[x]) for x in sorted(kinds)}
        best = max(share, key=lambda x: (share[x], [-ord(c) for c in x]))
        assert got[i][0] == best and abs(got[i][1] - min(1, max(0, share[best]))) < 1e-9, (i, share, got[i])
    assert len({p for p, _ in got.values()}) == 4
