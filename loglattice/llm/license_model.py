"""Trains the paragraph classifier of licence families: sparse logistic regression over word n-grams, on the driver.

The labelled rows are made from notices (below) and from plain paragraphs
that share words with them; their number is bounded by ``VARIANTS``. Weights
that stay small are set to zero; the others are rounded to millionths and kept
as whole numbers, so sums don't depend on their order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np

UNKNOWN = "unknown"
#: Noisy variants of each notice and each plain paragraph that are trained on: the bound of the sample.
VARIANTS = 24
SCALE = 1_000_000
#: Share of held-out paragraphs of no family that may be confirmed as a licence when the threshold is calibrated.
FALSE_PASSES = 0.005

#: Short notices by which licences name themselves.
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright the authors. All rights reserved. No part of this publication may be reproduced without prior written permission.",
    ),
}

#: Paragraphs that name licences or share their words but grant or reserve nothing.
PLAIN = (
    "The driver lost his license after the third offence and had to take the bus to work.",
    "Which license should a young project choose? The question comes up at every meeting.",
    "The general public was not allowed to attend, and the version of events that was published later differs.",
    "She reserved a table for two, and all of the rooms were taken as well.",
    "Free software has been discussed in this group under many headings over the years.",
    "The rights of workers were at the centre of the debate, and copyright law came next.",
    "The Apache helicopter landed at noon while the students of MIT watched.",
    "Permission to land was granted at four, without any conditions.",
    "The commons were open to the creative people of the town.",
    "Terms and conditions of the contest are published in the next issue.",
    "Version 2.0 of the report was released in May, and a source close to the authors confirmed it.",
    "Attribution of the painting to the master is not certain.",
)
#: Notices of licences outside the families and plain paragraphs, none of them trained on: what the threshold is calibrated with.
HELD_OUT = (
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Licensed under CC BY-NC-ND 4.0.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, version 1.3.",
    "Licensed under the Educational Community License, Version 2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License, version 1.0.",
    "This project is licensed under the terms of the zlib license.",
    "Distributed under the Boost Software License, version 1.0.",
    "Licensed under the European Union Public License, version 1.2.",
    "Released under the Artistic License.",
    "This program is licensed under the GNU Affero General Public License, version 3.",
    "You should have received a copy of the GNU Affero General Public License along with this program.",
    "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Released under the ISC License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0.",
    "This project is licensed under the terms of the Microsoft Public License.",
    "Licensed under the Open Software License, version 3.0.",
    "The committee published its report under a new title, and most of the rights went to the publisher.",
    "Students may use the source, subject to the permission of the library.",
    "He was granted a free copy of the program at the door.",
    "The license of the bar was not renewed by the city.",
    "A creative use of the commons is reserved for the public.",
)
#: What tells a family's licence from others of like wording: a notice that names it (one of these) confirms only a paragraph that does, too.
NAMES = {"apache": ("apache",), "mit": ("mit",), "gpl": ("gnu general",), "bsd": ("bsd",), "mpl": ("mozilla",), "cc-by": ("cc by", "commons attribution"), "cc-by-sa": ("by sa", "attribution sharealike"), "cc-by-nc": ("by nc", "attribution noncommercial"), "proprietary": ("rights reserved",)}
_DERIVED = ("by nd", "nc nd", "noderivatives", "noderivs", "no derivatives")
_SHARED = ("by sa", "nc sa", "sharealike", "share alike")
_UNSOLD = ("by nc", "noncommercial", "non commercial")
#: What stands in no notice of the family and names another licence.
OTHERS = {"mit": ("no attribution",), "cc-by": _DERIVED + _SHARED + _UNSOLD, "cc-by-sa": _DERIVED + _UNSOLD, "cc-by-nc": _DERIVED + _SHARED, "proprietary": ("some rights", "no rights")}
#: Share of a notice's n-grams that confirms a prediction.
CONFIRM = 0.6
FILLER = "the of and to in that for with on was by from this which are it were his her they one all not when have been had but what year time people day man way part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education".split()  # noqa: SIM905
#: Words too common to be evidence alone; they only count within a pair.
COMMON = frozenset("a all along an and any are as at be been but by can for form forms free from have in is it kind law may met not of on or part part prior provided required should source that the this to under use v with without work writing written you your following associated file files charge deal person obtaining received program published international general public version project style code terms copy subject binary".split())  # noqa: SIM905


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def features(text: str) -> set[str]:
    """Words that are evidence alone, and pairs of neighbours."""
    w = words(text)
    return {x for x in w if x not in COMMON and not x.isdigit()} | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def names(family: str, notice: str) -> list[str]:
    """Names of the family that the notice holds."""
    return [x for x in NAMES[family] if x in features(notice)]


def confirms(family: str, found: set[str]) -> bool:
    """The template check, as ``licenses.scan`` makes it."""
    if not found.isdisjoint(OTHERS.get(family, ())):
        return False
    return any(len(features(n) & found) >= CONFIRM * len(features(n)) and (not names(family, n) or not found.isdisjoint(names(family, n))) for n in NOTICES[family])


@dataclass(frozen=True)
class Model:
    """``weights``: feature -> one whole number a family, in the order of ``families``; the first family is the unknown one."""

    families: tuple[str, ...]
    bias: tuple[int, ...]
    weights: dict[str, tuple[int, ...]]
    threshold: float
    accuracy: float

    @property
    def marks(self) -> list[str]:
        """Words of which every feature holds one: a text without any of them has no feature."""
        out = {f for f in self.weights if " " not in f}
        for pair in sorted(f for f in self.weights if " " in f):
            if out.isdisjoint(pair.split()):
                out.add(max(pair.split(), key=lambda w: (len(w), w)))
        return sorted(out)

    def __post_init__(self):
        if max(self.bias) != self.bias[0]:
            raise ValueError("the bias alone must name the unknown class")


def _variants(random: Random, text: str, count: int, noise: bool) -> list[str]:
    out = [text]
    while len(out) < count:
        w = text.split()
        if noise and len(w) > 5:
            w = [x for x in w if random.random() > 0.05]
        lead = [random.choice(FILLER) for _ in range(random.choice((0, 0, 0, 4, 12)))]
        tail = [random.choice(FILLER) for _ in range(random.choice((0, 0, 0, 4, 12)))]
        out.append(" ".join(lead + w + tail))
    return out


def _sample(seed: int, plain: tuple[str, ...]) -> list[tuple[str, int]]:
    random, rows = Random(seed), []
    for i, notices in enumerate(NOTICES.values(), 1):
        rows += [(v, i) for n in notices for v in _variants(random, n, VARIANTS, True)]
    for p in plain:
        rows += [(v, 0) for v in _variants(random, p, VARIANTS, False)]
    rows += [(" ".join(random.choice(FILLER) for _ in range(random.randrange(1, 60))), 0) for _ in range(VARIANTS * len(plain))]
    return rows


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def trained(rounds: int = 300, rate: float = 1.0, shrink: float = 2e-4) -> Model:
    """Proximal gradient descent with an L1 penalty; the threshold comes from what held-out paragraphs of no family are confirmed as."""
    families = (UNKNOWN, *NOTICES)
    rows = _sample(1, PLAIN)
    known = sorted({f for n in NOTICES.values() for t in n for f in features(t)})
    place = {f: i for i, f in enumerate(known)}

    def matrix(sample: list[tuple[str, int]]) -> np.ndarray:
        x = np.zeros((len(sample), len(known)))
        for i, (t, _) in enumerate(sample):
            x[i, [place[f] for f in features(t) if f in place]] = 1.0
        return x

    x, y = matrix(rows), np.eye(len(families))[[k for _, k in rows]]
    w, b = np.zeros((len(known), len(families))), np.zeros(len(families))
    for _ in range(rounds):
        error = (_softmax(x @ w + b) - y) / len(rows)
        w -= rate * (x.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink, 0)
        b -= rate * error.sum(axis=0)
    w, b = np.round(w * SCALE).astype(np.int64), np.round(b * SCALE).astype(np.int64)
    used = np.flatnonzero(np.abs(w).sum(axis=1))
    held = _sample(2, HELD_OUT)
    chance = _softmax((matrix(held) @ w + b) / SCALE)
    truth = np.array([k for _, k in held])
    best = chance.argmax(axis=1)
    passes = np.array([k > 0 and confirms(families[k], features(t)) for k, (t, _) in zip(best, held, strict=True)])
    plain = np.where(passes, chance.max(axis=1), 0)[truth == 0]
    threshold = max(0.5, float(np.round(np.quantile(plain, 1 - FALSE_PASSES) + 0.01, 3)))
    named = np.where(passes & (chance.max(axis=1) >= threshold), best, 0)
    return Model(families, tuple(map(int, b)), {known[i]: tuple(map(int, w[i])) for i in used}, threshold, float((named == truth).mean()))
