"""License rules against a plain run of all of them, without gate and keywords; encrypted tokens as a whole."""

import base64
import json
import re
from re import _parser as parser

import numpy as np
import pytest

from tidemark.llm import licenses, secrets
from tidemark.llm.blocks import Block


def written(parsed, most):
    """A text that a parsed pattern matches: with as little as it may have, or with what it may leave out (once, up to three times)."""
    out = ""
    for kind, value in parsed:
        match str(kind):
            case "LITERAL":
                out += chr(value)
            case "IN":
                pick = value[-1 if most else 0]
                out += chr(pick[1] if str(pick[0]) == "LITERAL" else pick[1][0])
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += written(value[2], most) * (max(value[0], min(value[1], 3 if value[0] else 1)) if most else value[0])
            case "SUBPATTERN":
                out += written(value[3], most)
            case "BRANCH":
                out += written(value[1][-1 if most else 0], most)
            case "ASSERT":
                out += ""
            case other:
                raise AssertionError(other)
    return out


def plain_labels(text, rules):
    words = " " + re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", re.sub("[A-Z]+", lambda m: m[0].lower(), text)).strip() + " "
    hits = sorted((m.start(), -m.end(), -priority, label) for label, _, pattern, _, priority in rules for m in pattern.finditer(words))
    reach, labels = -1, {label for phrase, label in licenses.BASE.items() if f" {phrase} " in words}
    for _, end, _, label in hits:
        if -end > reach:
            reach = -end
            labels.add(label)
    return ",".join(sorted(labels))


def test_gate_and_keywords_drop_nothing(spark):
    rules = [(label, words, re.compile(pattern), sure, priority) for label, words, pattern, sure, priority in licenses.rules()]
    texts = [written(parser.parse(pattern), most).strip() for _, _, pattern, _, _ in licenses.rules() for most in (False, True)]
    texts += [f"{name}{mark}{number}" for name in ("MPL", "epl", "ofl", "AFL", "osl", "asl", "gpl", "lgpl", "cc0", "wtfpl") for mark in ("", "v", " v", "-v", " ", "-") for number in ("1", "1.1", "2", "2.0", "3", "3.0")]
    texts += ["mplvx", "compl v", "simpl", "the oslo office", "afl", "CC-BY-SA 4.0 and cc by-nc", "cczero", "CC Zero", "öfl v1", "mplé"]
    texts += [f"See {a}; also {b}." for a, b in zip(texts[::41], texts[7::41], strict=False)]
    found = licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()
    wrong = {(texts[r.doc_id], r.labels, w) for r in found if r.labels != (w := plain_labels(texts[r.doc_id], rules))}
    assert len(texts) > 1500 and wrong == set()
    by = dict(zip(texts, (r.labels for r in sorted(found, key=lambda r: r.doc_id)), strict=True))
    assert [by[t] for t in ("MPLv2", "eplv1", "oflv1.1", "AFLv3", "oslv2", "aslv2")] == ["mpl-2", "epl-1", "ofl-1.1", "afl-3", "osl-2", "apache-2"]


def test_signatures_are_many_and_hold_a_hint():
    signed = [*licenses.SIGNATURES, *licenses.NAMED, *licenses.BODIES]
    assert len({p for _, _, p in signed}) == len(signed) >= 195
    for _, words, pattern in [*licenses.NAMED, *licenses.BODIES]:
        for most in (False, True):
            text = written(parser.parse(pattern), most)
            assert any(h in text for h in (*licenses.HINTS, *(w for _, words, _ in licenses.SIGNATURES for w in words))) or re.search(licenses.SHORT_WORD, text), text
            assert any(re.search(rf"(?:^| ){w}(?: |$)", text) for w in words), text


def part(value):
    raw = value if isinstance(value, bytes) else json.dumps(value).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


SEALED = [f"{part({'alg': 'RSA-OAEP', 'enc': 'A256GCM'})}.{part(b'k' * 64)}.{part(b'n' * 12)}.{part(b'c' * 90)}.{part(b't' * 16)}", f"{part({'alg': 'dir', 'enc': 'A128CBC-HS256'})}..{part(b'n' * 16)}.{part(b'c' * 5)}.{part(b't' * 16)}", f"{part({'alg': 'dir', 'enc': 'A128GCM'})}...{part(b'c')}.{part(b't' * 16)}"]


@pytest.mark.parametrize("token", SEALED)
def test_nothing_of_an_encrypted_token_is_left(spark, token):
    text = f"Bearer {token}, and more... words...like.these.all.five."
    raw = text.encode()
    assert [(a, b) for a, b, kind in secrets.spans(raw) if kind == "jwt"] == [(7, 7 + len(token))]
    block = Block(0, 3, np.frombuffer(b"before" + raw + b"after", np.uint8), np.array([0, 6, 6 + len(raw), 11 + len(raw)]))
    assert 1 in secrets.suspects(block)
    left = secrets.redact_documents(spark.createDataFrame([(1, text), (2, "plain... text")], "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [r.text for r in left] == ["Bearer [secret], and more... words...like.these.all.five.", "plain... text"]


def test_a_signed_token_has_three_parts_and_four_dots_alone_are_none():
    signed = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.{part(b's' * 32)}"
    assert [(a, b) for a, b, kind in secrets.spans(f"{signed}.and.more".encode()) if kind == "jwt"] == [(0, len(signed))]
    assert secrets.spans(b"abcdefghijk..lmn.opq.rst and www.example.com.and.so.on") == []
