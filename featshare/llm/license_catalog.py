"""The licence templates: notices of licence families in all their members, and whole texts.

Look-alike licences have templates of the same form, so that the right one has the larger
coefficient. Whole texts are the files of ``license_texts``, named by licence.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

TEXTS = Path(__file__).with_name("license_texts")

GNU = [("GPL-1.0", "General Public", "1"), ("GPL-2.0", "General Public", "2"), ("GPL-3.0", "General Public", "3"),
       ("LGPL-2.0", "Library General Public", "2"), ("LGPL-2.0", "Lesser General Public", "2"),
       ("LGPL-2.1", "Lesser General Public", "2.1"), ("LGPL-3.0", "Lesser General Public", "3"),
       ("AGPL-3.0", "Affero General Public", "3")]
SUBJECTS = ("This program", "This library", "This software", "This file")
GNU_SHORT = ("This work is licensed under the GNU {x} License, version {v}.",
             "{s} is free software: you can redistribute it and/or modify it under the terms of the GNU {x} License as "
             "published by the Free Software Foundation, either version {v} of the License",
             "{s} is free software; you can redistribute it and/or modify it under the terms of the GNU {x} License "
             "version {v} as published by the Free Software Foundation")
GNU_LONG = GNU_SHORT[1] + (
    ", or (at your option) any later version. {s} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {x} "
    "License for more details. You should have received a copy of the GNU {x} License along with ")
GNU_ENDS = ("this program. If not, see <https://www.gnu.org/licenses/>.",
            "this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, "
            "MA 02110-1301 USA")

CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
      ("BY-ND", "Attribution-NoDerivatives"), ("BY-ND", "Attribution-NoDerivs"),
      ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
      ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs")]
CC_VERSIONS = [("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")]
CC_FORMS = ("Licensed under CC {k} {v}.", "This work is licensed under a Creative Commons {n} {v} {w} License.",
            "Licensed under the Creative Commons {n} {v} {w} License.", "Licensed under the Creative Commons {n} {v} License.",
            "Licensed under Creative Commons {n} {v}.")

NOTICES = [
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may "
                "not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License v1.0 which accompanies this distribution, and is available at "
                "http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License v2.0 which accompanies this distribution, and is available at "
                "https://www.eclipse.org/legal/epl-v20.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "Licensed under the Eclipse Public License, Version 1.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy "
                "at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
                "rights to this software to the public domain worldwide. This software is distributed without any warranty."),
]


def _gnu():
    for name, x, v in GNU:
        yield name, GNU_SHORT[0].format(x=x, v=v)
        for s in SUBJECTS:
            yield from ((name, form.format(s=s, x=x, v=v)) for form in GNU_SHORT[1:])
            yield from ((name, GNU_LONG.format(s=s, x=x, v=v) + end) for end in GNU_ENDS)


def _creative_commons():
    for k, n in CC:
        yield from ((f"CC-{k}-{v}", form.format(k=k, n=n, v=v, w=w))
                    for v, w in CC_VERSIONS for form in CC_FORMS)


@cache
def more_templates() -> tuple[tuple[str, str], ...]:
    """(licence, template) of all notices and whole texts here, each once."""
    whole = ((p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt")))
    return tuple(dict.fromkeys([*_gnu(), *_creative_commons(), *NOTICES, *whole]))
