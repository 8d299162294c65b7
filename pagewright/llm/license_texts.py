"""Whole texts of short public licences, and the notices by which works name longer ones.

Years, names and the like, which differ from work to work, are left out.
"""

from __future__ import annotations

import re
from importlib.resources import files



PERMISSION_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
NOTICE_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
OPENING_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
CLAUSES_BSD = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
CLAUSE_3_BSD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
PERMISSION_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies."""
WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
GNU = "as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version."
GNU_WARRANTY = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
GNU_COPY = "You should have received a copy of the GNU {0} Public License along with this program. If not, see"
CC = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License"

#: Passages by label: each counts by itself.
TEMPLATES = {
    "0bsd": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + WARRANTY_ISC],
    "agpl": [
        "it under the terms of the GNU Affero General Public License " + GNU.format(3),
        "licensed under the GNU Affero General Public License, version 3",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "bsd": [OPENING_BSD, CLAUSES_BSD, WARRANTY_BSD],
    "bsd-2-clause": [f"{OPENING_BSD} {CLAUSES_BSD} {WARRANTY_BSD}"],
    "bsd-3-clause": [f"{OPENING_BSD} {CLAUSES_BSD} {CLAUSE_3_BSD} {WARRANTY_BSD}", CLAUSE_3_BSD],
    "bsl": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "cc-by": ["Licensed under CC BY 4.0", CC.format("")],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", CC.format("-NonCommercial")],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", CC.format("-ShareAlike")],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "gpl": [
        "licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License " + GNU.format(2),
        "it under the terms of the GNU General Public License " + GNU.format(3),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License " + GNU.format(3) + " This program "
        + GNU_WARRANTY + " See the GNU General Public License for more details. " + GNU_COPY.format("General"),
    ],
    "isc": [PERMISSION_ISC, f"{PERMISSION_ISC} {WARRANTY_ISC}"],
    "lgpl": [
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "it under the terms of the GNU Lesser General Public License " + GNU.format("2.1"),
    ],
    "mit": ["Released under the MIT License", PERMISSION_MIT, WARRANTY_MIT, f"{PERMISSION_MIT} {NOTICE_MIT} {WARRANTY_MIT}"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain",
    ],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software. This notice may not be removed or altered from any source distribution.",
    ],
}

#: Whole texts of long licences, in the folder `licenses`: their terms, and each numbered section of LEAST_SECTION words or more, count by themselves.
LONG = {"apache": ["Apache-2.0"], "gpl": ["GPL-2", "GPL-3"], "lgpl": ["LGPL-2.1", "LGPL-3"], "mpl": ["MPL-2.0"]}
LEAST_SECTION = 40
SECTION = re.compile(r"^\s*(?=\d+\.(?:\s|\d+\.))", re.M)
END = "END OF TERMS AND CONDITIONS"


def long_texts(name: str) -> list[str]:
    """The terms of a licence and its sections."""
    text = (files(__package__) / "licenses" / f"{name}.txt").read_text(encoding="utf-8").partition(END)[0]
    return [text, *[x for x in SECTION.split(text) if len(x.split()) >= LEAST_SECTION]]


for label, names in LONG.items():
    TEMPLATES[label] += [x for name in names for x in long_texts(name)]
