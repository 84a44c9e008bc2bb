from lattica.llm import op7_licenses as o


def brute(text, templates):
    words = o.normal_words(text or "")
    out = {}
    for name, body in templates.items():
        own = o.normal_words(body)
        length, stride = o.window_shape(len(own))
        want = set(o.shingles_of(own))
        last = max(len(words) - length, 0)
        for at in sorted({*range(0, last + 1, stride), last}):
            k = len(want & set(o.shingles_of(words[at : at + length]))) / len(want)
            if k >= o.CONTAINMENT:
                best = out.get(name, (0, at))
                out[name] = (max(best[0], k), min(best[1], at))
    return out


def test_against_brute_force(spark):
    filler = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", "MIT", filler, filler * 40]
    for body in o.TEMPLATES.values():
        words = body.split()
        texts += [body, f"{filler} {body.upper()} {filler}", f"{filler}\n{body}", " ".join(words[: len(words) // 2]), " ".join(words[:-1]) + " changed", " ".join(w if i != len(words) // 2 else "swapped" for i, w in enumerate(words))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {}
    for r in o.scan(docs).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.containment, r.first_word)
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t, o.TEMPLATES))}


def test_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "x Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.first_word) for r in o.scan(docs).collect()) == [(0, 0), (1, 0)]
    assert o.scan(docs.limit(0)).count() == 0 and o.scan(docs, {}).count() == 0
