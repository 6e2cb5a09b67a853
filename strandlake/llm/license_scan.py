"""Licence notices: a paragraph classifier over sparse word n-grams, confirmed by templates.

1. A paragraph is a run of lines with words. Within one, a notice is proposed
   where a licence's name or identifier stands, with the words that lead to it,
   or where enough word pairs of a longer text lie close together; so notices
   are found by themselves, be they wrapped over lines or inside of long ones.
2. Hashed words and word pairs of a proposal feed a logistic regression over
   licence families and an unknown class, which is made of prose and of other
   licences. It is trained here, on variations of the notices below.
3. Its probabilities are calibrated on variations, prose and licences that it
   was not trained on: a family needs the least probability from which on the
   share of right ones is PRECISION.
4. The predicted family's template confirms it: the words that tell families
   apart must be there, and SHARED of the template's word pairs.

A name without a lead is a notice only where it is a line by itself. A GNU
licence without its version has no family. Each row is scanned by its text
alone; null, empty and blank texts have no notices, and an empty table gives an
empty one. The work grows with the words of a text and with its proposals; a
very long text is one row. Other columns than doc_id and text are not looked at.
"""

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import map_arrow, text_or_empty
from strandlake.llm.words import buffers, groups, mix, word_runs

# Texts of notices by family.
BODIES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one"],
    "ISC": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
# Words, in order, that a text of a family must have.
TELLING = {
    "GPL-2.0": ["gnu general public license", "version 2"], "GPL-3.0": ["gnu general public license", "version 3"], "AGPL-3.0": ["affero general public license", "version 3"],
    "LGPL-2.1": ["lesser general public license", "version 2 1"], "LGPL-3.0": ["lesser general public license", "version 3"],
}
# Names of licences and their identifiers.
_GNU = {"GPL-2.0": ("General", "GPL", "2", "2.0"), "GPL-3.0": ("General", "GPL", "3", "3.0"), "LGPL-2.1": ("Lesser General", "LGPL", "2.1", "2.1"), "LGPL-3.0": ("Lesser General", "LGPL", "3", "3.0"), "AGPL-3.0": ("Affero General", "AGPL", "3", "3.0")}
_CC = {"CC-BY-4.0": ("BY", "Attribution"), "CC-BY-SA-4.0": ("BY-SA", "Attribution-ShareAlike"), "CC-BY-NC-4.0": ("BY-NC", "Attribution-NonCommercial"), "CC-BY-ND-4.0": ("BY-ND", "Attribution-NoDerivatives"), "CC-BY-NC-SA-4.0": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike")}
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "Expat License", "MIT-style license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache 2.0"],
    **{f: [f"GNU {name} Public License, version {v}", f"GNU {name} Public License v{v}", f"GNU {short} version {v}", f"GNU {short} v{v}", f"GNU {short} {v}", f"{short} version {v}", f"{short} v{v}", f"{short}v{v} license", f"the {short}v{v}", f"under {short}v{v}", f"GNU {short}v{v}", f"{short}-{w}", f"version {v} of the GNU {name} Public License"] for f, (name, short, v, w) in _GNU.items()},
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License", "2-Clause BSD License", "New BSD License", "BSD License", "BSD-style license", "modified BSD license"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL version 2.0", "MPL v2.0"],
    **{f: [f"CC {short} 4.0", f"Creative Commons {name} 4.0 International License", f"Creative Commons {name} 4.0", f"Creative Commons {name.replace('Non', 'Non-').replace('No-', 'No').replace('ShareAlike', 'Share-Alike')} 4.0"] for f, (short, name) in _CC.items()},
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0", "Creative Commons CC0"],
    "ISC": ["ISC License", "ISC Licence"],
    "Unlicense": ["The Unlicense", "Unlicense license"],
    "proprietary": [],
}
IDENTIFIERS = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL-2.0": ["MPL-2.0"], "ISC": ["ISC"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0-1.0"],
    **{f: [f"{short}-{w}", f"{short}-{w}-only", f"{short}-{w}-or-later"] for f, (_, short, _, w) in _GNU.items()}, **{f: [f] for f in _CC},
}
#: These stand by themselves; the second kind must also end its sentence.
WHOLE = {"proprietary": ["All rights reserved"], **{f: [f"SPDX-License-Identifier: {x}" for x in ids] for f, ids in IDENTIFIERS.items()}}
for _f in ("MIT", "ISC", "Unlicense", "BSD"):
    WHOLE[_f] += [f"{lead} {'BSD' if _f == 'BSD' else _f}" for lead in ("Licensed under", "Licensed under the", "Released under", "License:")]
CLOSED = "proprietary"
# Words between the names of a choice or a list of licences.
BETWEEN = ["or", "and", "and or", "or the", "and the", "and or the"]
# Licences that are no family here; half of them are for calibration only.
OTHERS = [
    "Eclipse Public License 2.0", "Artistic License 2.0", "zlib License", "Boost Software License 1.0", "Open Software License 3.0", "European Union Public Licence 1.2", "SIL Open Font License 1.1", "Python Software Foundation License",
    "Common Development and Distribution License 1.0", "Microsoft Public License", "Academic Free License 3.0", "PostgreSQL License", "Universal Permissive License 1.0", "Open Data Commons Attribution License 1.0", "Server Side Public License 1", "Ruby License", "Business Source License 1.1", "W3C Software Notice",
]
LEADS = [
    "Licensed under the", "Licensed under", "Released under the", "Released under", "Distributed under the", "Available under the", "Published under the", "Provided under the", "This project is licensed under the terms of the",
    "This work is licensed under the", "This work is licensed under a", "under the terms of the", "subject to the terms of the", "governed by the", "governed by a", "covered by the", "License", "made available under the",
]

FAMILIES = [*NAMES, "unknown"]
#: Notices of each family as whole texts, the shortest lead first.
TEMPLATES = {f: [*(f"Released under the {n}." for n in NAMES[f][:1]), *BODIES.get(f, []), *(f"This project is licensed under the terms of the {n}." for n in NAMES[f]), *(f"{n}." for n in WHOLE.get(f, []))] for f in NAMES}
SLOTS = 1 << 16
#: Share of a template's word pairs that a confirmed notice has; share of right ones that calibration asks for.
SHARED, PRECISION = 0.6, 0.99
#: Words before a name in which its lead may stand.
REACH = 14

_U = np.uint64
_PLAIN = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not (chr(_c).isalnum() or _c == 10):
        _PLAIN[_c] = 32


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, one less than there are words."""
    return mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:])


def _words(texts: list[str]) -> list[np.ndarray]:
    raw, at = buffers(pa.array(texts, pa.string()))
    words, _, _, first = word_runs(_PLAIN[raw], at)
    return [words[s:e] for s, e in zip(first[:-1], first[1:], strict=True)]


# the classifier


def _grams(words: np.ndarray) -> np.ndarray:
    """Slots of a notice's words and word pairs."""
    return (np.concatenate([words, _pairs(words)]) % _U(SLOTS)).astype(np.int64)


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _examples(seed: int, each: int, others: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Notices of each family with words dropped and added; prose of made-up and ordinary words, and other licences."""
    rng = np.random.default_rng(seed)
    common = "the of and to in is this that work under version use file with for any free software general public terms copy all source form rights by license".split()
    syllables = "an be de er es ha in la le nd on or ou re st th ti wh que ent ion ung sch ado ció eux".split()
    made = lambda n: ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(n)]
    pick = lambda xs: xs[rng.integers(len(xs))]
    texts, kinds = [], []
    for k, f in enumerate(NAMES):
        for _ in range(each):
            kind = rng.random()
            if f in BODIES and kind < 0.35:
                words = pick(BODIES[f]).split()
                words = [w for w in words if rng.random() > 0.08]
            elif WHOLE.get(f) and (kind < 0.5 or not NAMES[f]):
                words = pick(WHOLE[f]).split()
            else:
                lead = pick(LEADS).split()
                words = [*(w for w in lead if rng.random() > 0.1), *pick(NAMES[f]).split()]
            apart = f == CLOSED  # a sentence by itself
            texts.append(" ".join([*made(0 if apart else rng.integers(0, 2)), *words, *made(0 if apart else rng.integers(0, 3))]) + "." * apart)
            kinds.append(k)
    for _ in range(each * 4):
        n = int(rng.integers(1, 60))
        words = [w if rng.random() > 0.15 else str(rng.choice(common)) for w in made(n)]
        if rng.random() < 0.2:
            words = [str(w) for w in rng.choice(common, n)]
        if rng.random() < 0.5:
            words = f"{pick(LEADS)} {pick(others or OTHERS)}".split()
        texts.append(" ".join(words))
        kinds.append(len(NAMES))
    return texts, np.array(kinds)


def _sorted_sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], starts, axis=0)


@cache
def model() -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, biases and the probability that a family needs."""
    texts, kinds = _examples(1, 100, OTHERS[::2])
    grams = [_grams(w) for w in _words(texts)]
    sizes = np.array([len(g) for g in grams])
    row, flat = np.repeat(np.arange(len(grams)), sizes), np.concatenate(grams)
    used, slot = np.unique(flat, return_inverse=True)
    x = (1 / np.sqrt(sizes))[row][:, None]
    by_row, by_slot = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.argsort(slot, kind="stable")
    slot_starts = np.concatenate(([0], np.cumsum(np.bincount(slot))[:-1]))
    want, n = np.eye(len(FAMILIES))[kinds], len(texts)
    w, bias = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    move, push = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(120):
        slope = (_probabilities(np.add.reduceat(w[slot] * x, by_row, axis=0) + bias) - want) / n
        move = 0.9 * move + _sorted_sums(slope[row] * x, by_slot, slot_starts) + 1e-6 * w
        push = 0.9 * push + slope.sum(0)
        w -= 12 * move
        bias -= 3 * push
    weights = np.zeros((SLOTS, len(FAMILIES)), np.float32)
    weights[used] = w
    held, kind = _examples(2, 100, OTHERS[1::2])
    p = np.array([probability(weights, bias, v) for v in _words(held)])
    best, sure = p[:, :-1].argmax(1), p[:, :-1].max(1)
    order = np.argsort(-sure, kind="stable")
    right = np.cumsum(best[order] == kind[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(right >= PRECISION)
    return weights, bias, float(sure[order[enough[-1]]]) if len(enough) else 1.0


def probability(weights: np.ndarray, bias: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each family, and of unknown as the last, for a notice's words."""
    g = _grams(words)
    return _probabilities(weights[g].sum(0) / np.sqrt(len(g)) + bias)


# templates


@cache
def _names() -> dict[int, list[tuple[tuple, int, bool]]]:
    """First pair of a name: its words, family (-1 for another licence) and whether it stands by itself; the longest first."""
    out: dict[int, list] = {}
    kinds = [(n, FAMILIES.index(f), False) for f, ns in NAMES.items() for n in ns] + [(n, FAMILIES.index(f), True) for f, ns in WHOLE.items() for n in ns] + [(n, -1, False) for n in OTHERS]
    for (_, family, whole), words in zip(kinds, _words([n for n, _, _ in kinds]), strict=True):
        out.setdefault(int(_pairs(words)[0]), []).append((tuple(words.tolist()), family, whole))
    return {k: sorted(v, key=lambda x: -len(x[0])) for k, v in out.items()}


@cache
def _leads() -> list[np.ndarray]:
    return _words(LEADS)


@cache
def _between() -> set[tuple]:
    return {tuple(w.tolist()) for w in _words(BETWEEN)}


@cache
def _bodies() -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Family, word pairs and telling words of each text."""
    return [(FAMILIES.index(f), np.unique(_pairs(_words([t])[0])), _words(TELLING.get(f, []))) for f, texts in BODIES.items() for t in texts]


@cache
def _body_pairs() -> np.ndarray:
    return np.unique(np.concatenate([p for _, p, _ in _bodies()]))


def _named(words: np.ndarray, pairs: np.ndarray, paragraph: np.ndarray) -> list[tuple[int, int, int, bool, float]]:
    """Family, first word, word past the last, whether a lead is there (or none needed), and shared of names in words."""
    names = _names()
    found, end = [], 0
    for k in np.flatnonzero(np.isin(pairs, np.fromiter(names, np.uint64, len(names)))).tolist():
        for own, family, whole in names[int(pairs[k])]:
            stop = k + len(own)
            if stop <= len(words) and paragraph[k] == paragraph[stop - 1] and tuple(words[k:stop].tolist()) == own:
                found.append((k, stop, family, whole))
                break
    # a name inside of a longer one, as of one that begins before it, is no name
    found.sort(key=lambda x: (x[0] - x[1], x[0]))
    free, kept = np.ones(len(words) + 1, bool), []
    for s, e, family, whole in found:
        if free[s:e].all():
            free[s:e] = False
            kept.append((s, e, family, whole))
    out = []
    for s, e, family, whole in sorted(kept):
        linked = out and out[-1][3] and out[-1][4] >= SHARED and out[-1][2] == end and tuple(words[end:s].tolist()) in _between() and paragraph[end - 1] == paragraph[s]
        if family >= 0 and (whole or linked):
            out.append((family, s, e, True, 1.0))
        elif family >= 0:
            low = max(end, s - REACH)
            low += int(np.searchsorted(paragraph[low:s], paragraph[s]))
            best = (0.0, 0, s, False)
            for lead in _leads():
                own = _pairs(np.concatenate([lead, words[s:e]]))
                there = np.flatnonzero(np.isin(pairs[low : e - 1], own)) + low
                shared = len(np.intersect1d(own, pairs[low : e - 1])) / len(own)
                before = _pairs(lead) if len(lead) > 1 else own[:1]  # more than the word at the name
                best = max(best, (shared, len(own), int(there[0]), bool(np.isin(pairs[low:s], before).any())))
            out.append((family, best[2], e, best[3], best[0]))
        end = e
    return out


def _windows(pairs: np.ndarray, paragraph: np.ndarray, own: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """Of windows with enough of a text's pairs own, the fullest that do not overlap: pairs found, first and last word. Pairs are those at words at."""
    need, most = int(np.ceil(SHARED * len(own) - 1e-9)), 2 * len(own) + 4
    live = np.isin(pairs, own)
    pairs, paragraph, hit = pairs[live], paragraph[live], at[live]
    n, found = len(hit), []
    if n < need:
        return []
    near, far = slice(0, n - need + 1), slice(need - 1, n)
    for k in np.flatnonzero((hit[far] - hit[near] < most) & (paragraph[far] == paragraph[near])).tolist():
        seen, last = set(), k
        for i in range(k, int(np.searchsorted(hit, hit[k] + most))):
            if paragraph[i] != paragraph[k]:
                break
            if pairs[i] not in seen:
                seen.add(pairs[i])
                last = i
        if len(seen) >= need:
            found.append((len(seen), int(hit[k]), int(hit[last]) + 1))
    return _apart(found)


def _apart(found: list[tuple]) -> list[tuple]:
    """Those with the most pairs, then the shortest, that do not overlap others; x[1] and x[2] are first and last word."""
    import bisect

    out: list[tuple] = []
    ends: list[tuple[int, int]] = []  # kept ones in order
    for x in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        k = bisect.bisect_left(ends, (x[1], x[2]))
        if (k == 0 or ends[k - 1][1] < x[1]) and (k == len(ends) or x[2] < ends[k][0]):
            ends.insert(k, (x[1], x[2]))
            out.append(x)
    return out


def _told(words: np.ndarray, telling: list[np.ndarray]) -> bool:
    """The sequences stand in words, one behind the other."""
    at = 0
    for own in telling:
        starts = np.flatnonzero(words[at : len(words) - len(own) + 1] == own[0]) + at
        hit = next((int(k) for k in starts if (words[k : k + len(own)] == own).all()), None)
        if hit is None:
            return False
        at = hit + len(own)
    return True


def proposals(words: np.ndarray, line: np.ndarray, paragraph: np.ndarray, closed: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Family, first word, word past the last and shared of what templates propose; closed marks words that end a sentence or line."""
    if len(words) < 2:
        return []
    pairs = _pairs(words)
    pairs[np.diff(paragraph) != 0] = 0
    counts = np.bincount(line)
    found = []
    for family, s, e, lead, shared in _named(words, pairs, paragraph):
        alone = line[s] == line[e - 1] and counts[line[s]] <= e - s + 1
        if FAMILIES[family] == CLOSED and not (closed[e - 1] and (s == 0 or line[s - 1] != line[s] or closed[s - 1])):
            continue
        if shared >= SHARED and (lead or alone):
            found.append((e - s, s, e - 1, family, shared))
    at = np.flatnonzero(np.isin(pairs, _body_pairs()))  # few; only their surroundings are looked at
    for family, own, telling in _bodies():
        for n, s, last in _windows(pairs[at], paragraph[at], own, at):
            if _told(words[s : last + 1], telling):
                found.append((n + 1, s, last, family, n / len(own)))
    return [(family, s, last + 1, shared) for _, s, last, family, shared in _apart(found)]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (line number from 0, of its start), start, end (code points), family, probability and shared for each notice.

    Where a notice is all of a line, or all but a word, its span is the line, else from its first to its last word.
    """
    trained = docs.sparkSession.sparkContext.broadcast(model())  # fixed size

    def f(batch: pa.RecordBatch):
        weights, bias, least = trained.value
        raw, offsets = buffers(batch.column("text"))
        docs_, rows = batch.column("doc_id").to_pylist(), []
        for a, b in groups(offsets):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts = np.unique(np.concatenate([at[:-1], np.flatnonzero(part == 10) + 1]))
            starts = starts[starts < len(part)]
            if not len(starts):
                continue
            words, begins, stops, first = word_runs(_PLAIN[part], np.append(starts, len(part)))
            line = np.repeat(np.arange(len(first) - 1), np.diff(first))
            if len(line) < 2:
                continue
            begins, stops = begins - line, stops - line  # word_runs puts a space behind each line
            doc = np.searchsorted(at, starts, "right") - 1
            paragraph = np.concatenate(([0], np.cumsum((np.diff(line) > 1) | (np.diff(doc[line]) > 0))))
            follows = np.append(part, np.uint8(10))[stops]
            closed = np.isin(follows, np.frombuffer(b".;,)\n\r!", np.uint8))
            places = None
            for k, s, e, shared in proposals(words, line, paragraph, closed):
                p = probability(weights, bias, words[s:e])
                if p.argmax() != k or p[k] < least:
                    continue
                if places is None:  # code points and line ends before each byte
                    places = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80))), np.concatenate(([0], np.cumsum(part == 10)))
                x, y = begins[s], stops[e - 1]
                if line[s] == line[e - 1] and first[line[s] + 1] - first[line[s]] <= e - s + 1:
                    x = starts[line[s]]
                    y = starts[line[s] + 1] if line[s] + 1 < len(starts) else len(part)
                    y = min(y, at[doc[line[s]] + 1])
                    y -= y > x and part[y - 1] == 10
                d = doc[line[s]]
                chars, ends = places
                rows.append((docs_[a + d], int(ends[x] - ends[at[d]]), int(chars[x] - chars[at[d]]), int(chars[y] - chars[at[d]]), FAMILIES[k], float(p[k]), float(shared)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "paragraph", "start", "end", "family", "probability", "shared"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(slim, f, "doc_id long, paragraph long, start long, end long, family string, probability double, shared double")
