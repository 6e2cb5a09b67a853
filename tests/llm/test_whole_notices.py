"""Licence notices that are wrapped over lines or stand inside of a long one."""

import textwrap

import numpy as np

from strandlake.llm import license_scan

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
MIT = license_scan.TEMPLATES["MIT"][1]
PROSE = "the été was long and the river of the town was low so that boats lay in the mud by the old mill"
LONG = " ".join([PROSE] * 12)


def commented(text, mark):
    return "\n".join(mark + x for x in text.split("\n"))


CASES = [
    (GPL, ["GPL-3.0"]), (BSD, ["BSD"]), (commented(GPL, "# "), ["GPL-3.0"]), (commented(BSD, " * "), ["BSD"]),
    (f"{PROSE}\n{GPL}\n{PROSE}", ["GPL-3.0"]), (f"{PROSE}\n\n{commented(BSD, '// ')}\n\n{GPL}", ["BSD", "GPL-3.0"]),
    (f"{LONG} {MIT} {LONG}", ["MIT"]), (f"{LONG}\n{LONG} {' '.join(GPL.split())} {LONG}", ["GPL-3.0"]), (textwrap.fill(f"{LONG} {MIT}. {LONG}", 50), ["MIT"]),
    (f"{LONG} Licensed under CC BY-NC 4.0. {LONG}", ["CC-BY-NC-4.0"]), (LONG, []), (textwrap.fill(LONG, 40), []), (GPL.replace("\n", "\n\n"), []),
]
ENDS = {"GPL-3.0": ("This", "version"), "BSD": ("Redistribution", "met"), "MIT": ("Permission", "files"), "CC-BY-NC-4.0": ("Licensed", "0")}


def test_wrapped_and_embedded(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = sorted(license_scan.scan_licenses(docs).collect(), key=lambda r: (r.doc_id, r.start))
    for k, (text, want) in enumerate(CASES):
        own = [r for r in got if r.doc_id == k]
        assert [r.family for r in own] == want, (k, own)
        for r in own:
            part = text[r.start : r.end]
            whole = part in text.split("\n") and all(x in part for x in ENDS[r.family])  # a line that is a notice by itself
            assert whole or part.startswith(ENDS[r.family][0]) and part.endswith(ENDS[r.family][1])
            assert r.paragraph == text[: r.start].count("\n") and r.shared >= 0.6


def test_no_words():
    none = np.zeros(0, np.int64)
    assert license_scan.proposals(none.astype(np.uint64), none, none, none.astype(bool)) == []


# notices as they stand in projects; none of them is a template, and few of their wordings
NATURAL = [
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "BSD"),
    ("<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->", "CC-BY-SA-4.0"), ("Licensed under the MPL 2.0", "MPL-2.0"), ("This software is distributed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("Foo is released under the GNU GPL version 3 or later; see COPYING.", "GPL-3.0"), ("The code in this repository is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("You can use it under the terms of the GNU General Public License v2.", "GPL-2.0"), ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD"),
    ("All documentation is made available under the Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"), ("Photos are published under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Text is available under the Creative Commons Attribution-ShareAlike 4.0 License", "CC-BY-SA-4.0"),
    ("Copyright 2019 The Foo Authors. All rights reserved.", "proprietary"), ("(c) ACME GmbH, 2004-2011. All rights reserved.\nDo not copy.", "proprietary"),
    ("    This library is free software; you can redistribute it and/or\n    modify it under the terms of the GNU Lesser General Public\n    License as published by the Free Software Foundation; either\n    version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    (" * This file is part of Foo.\n *\n * Foo is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.", "GPL-2.0"),
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as\n# published by the Free Software Foundation, either version 3 of the\n# License, or (at your option) any later version.", "AGPL-3.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction", "MIT"),
    ("Redistributions and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the notice", "BSD"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at", "Apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "ISC"),
    ("License: Apache 2.0", "Apache-2.0"), ("GNU Affero General Public License v3.0", "AGPL-3.0"), ("MIT License\n\nCopyright (c) 2020 somebody", "MIT"), ("## License\n\nApache License, Version 2.0", "Apache-2.0"), ("It is distributed under the 3-Clause BSD License.", "BSD"), ("Released under the Unlicense license, do as you like.", "Unlicense"),
]
OTHERWISE = [
    "All rights reserved by the mountain goats.", "The goats have all rights reserved for them on this path", "The lake is licensed under the city council, version 2.0", "A driving license is a document", "We went to MIT and had a License to fish",
    "Licensed under the Eclipse Public License 2.0", "This project is licensed under the terms of the Boost Software License 1.0.", "Released under the zlib License", "SPDX-License-Identifier: EPL-2.0", "subject to the terms of the European Union Public Licence 1.2", "SPDX-License-Identifier: WTFPL",
    "This program is free software, you may share it with whom you like", "Permission is hereby granted to cross the field", "the source and the binary forms of life, with or without modification", "Version 3 of the general is out in public", "Apache helicopters flew 2.0 miles", "the terms of the general public are that each has a copy of this book", PROSE,
]


def test_notices_that_no_template_holds(spark):
    """Precision and recall of at least 0.9, by themselves, in prose, and within long lines."""
    frames = {}
    for how in ("alone", "between lines", "in a line"):
        for k, (text, family) in enumerate([*NATURAL, *((t, None) for t in OTHERWISE)]):
            body = {"alone": text, "between lines": f"{PROSE}\n{text}\n{PROSE}", "in a line": f"{LONG}. {' '.join(text.split())} {LONG}"}[how]
            frames[len(frames)] = how, family, body, k
    docs = spark.createDataFrame([(d, x[2]) for d, x in frames.items()], "doc_id long, text string")
    got = {}
    for r in license_scan.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append(r.family)
    for how in ("alone", "between lines", "in a line"):
        own = {d: x for d, x in frames.items() if x[0] == how}
        right = sum(got.get(d, []) == [x[1]] for d, x in own.items() if x[1])
        found = sum(len(got.get(d, [])) for d in own)
        hits = sum(got.get(d, []).count(x[1]) for d, x in own.items())
        wrong = [(x[1], got.get(d), x[2][:60]) for d, x in own.items() if got.get(d, []) != [x[1]] * bool(x[1])]
        least = 0.9 if how != "in a line" else 0.8  # a name that was a line by itself is none there
        assert right >= least * len(NATURAL) and hits >= 0.9 * found, (how, right, hits, found, wrong)


def test_work_follows_the_notices():
    """Twice the notices take about twice the time, in one text."""
    import time

    import pyarrow as pa

    def took(n):
        lines = [f"Released under the MIT License. SPDX-License-Identifier: GPL-{2 + k % 2}.0-only and so on {k}" for k in range(n)]
        raw, at = license_scan.buffers(pa.array(["\n".join(lines)]))
        words, begins, stops, first = license_scan.word_runs(license_scan._PLAIN[raw], np.append(np.concatenate([[0], np.flatnonzero(raw == 10) + 1]), len(raw)))
        line = np.repeat(np.arange(len(first) - 1), np.diff(first))
        began = time.perf_counter()
        found = license_scan.proposals(words, line, np.zeros(len(words), int), np.ones(len(words), bool))
        assert len(found) == 2 * n
        return time.perf_counter() - began

    took(500)
    assert took(8000) < 6 * took(4000)


def test_calibration_is_by_examples():
    _, _, least = license_scan.model()
    assert 0 < least < 1 and least != 0.5


def test_several_licences(spark):
    cases = [("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("Licensed under MIT or the Apache License, Version 2.0, at your option.", ["MIT", "Apache-2.0"]), (f"{PROSE}. It is dual licensed under the GNU GPL v2 and the BSD License. {PROSE}", ["GPL-2.0", "BSD"]), ("Licensed under GPLv3", ["GPL-3.0"]), ("License: MIT", ["MIT"]), ("We like the MIT License and the Apache License 2.0 as names", [])]
    got = license_scan.scan_licenses(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    for k, (text, want) in enumerate(cases):
        own = sorted((r.start, r.end, r.family) for r in got if r.doc_id == k)
        assert [x[2] for x in own] == want and all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False)), (text, own)
