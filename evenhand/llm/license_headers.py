"""Standard headers and licence texts that files are compared with. Fixed values."""

from __future__ import annotations

import pkgutil

_GNU = (
    "This {it} is free software{or_}: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, {version}. "
    "This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with this {it}{end}"
)
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_KEEP = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE '
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_SECTION_13 = (
    "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer "
    "all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to "
    "the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. "
)
# What names a license in a sentence of a file that has the text elsewhere.
_NAMED = (
    "This file is released under the {} license; see the LICENSE file for details.",
    "Use of this source code is governed by the {} license that can be found in the LICENSE file.",
)
_NAMES = {"Apache-2.0": "Apache 2.0", "BSD-2-Clause": "BSD 2-Clause", "BSD-3-Clause": "BSD 3-Clause", "ISC": "ISC", "MIT": "MIT", "MPL-2.0": "Mozilla Public 2.0"}


def _gnu(kind: str, number: str, end: str) -> list[str]:
    """The header of a version, alone and "or later", for programs, files and libraries, with the older and the newer beginning."""
    versions = (f"version {number} of the License", f"either version {number} of the License, or (at your option) any later version")
    return [_GNU.format(it=it, or_=or_, kind=kind, version=v, end=end) for v in versions for it, or_ in (("program", ""), ("library", "; "))]


def _text(name: str) -> str:
    return pkgutil.get_data("evenhand.llm", f"license_texts/{name}.txt").decode()


def standard_texts() -> dict[str, tuple[str, ...]]:
    """Headers and whole texts by license."""
    gpl = _text("GPL-3.0")
    # The two differ in name and section 13.
    affero = gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General Public License", "GNU Affero General Public License").replace("13. Use with the GNU Affero General Public License.", _SECTION_13)
    mozilla = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    )
    foundation = (
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. "
        "The ASF licenses this file to You under the Apache License, Version 2.0 "
    )
    out = {
        "AGPL-3.0": [*_gnu("Affero ", "3", _SEE), affero],
        "Apache-2.0": [apache, foundation + apache.split("Version 2.0 ", 1)[1], _text("Apache-2.0")],
        "BSD-2-Clause": [_BSD + _KEEP + _AS_IS],
        "BSD-3-Clause": [_BSD + _KEEP + _ENDORSE + _AS_IS, _text("BSD-3-Clause")],
        "CC0-1.0": [_text("CC0-1.0")],
        "GPL-2.0": [*_gnu("", "2", _SEE), *_gnu("", "2", _WRITE), _text("GPL-2.0")],
        "GPL-3.0": [*_gnu("", "3", _SEE), gpl],
        "ISC": [_ISC_GRANT + _ISC_AS_IS, "ISC License " + _ISC_GRANT + _ISC_AS_IS],
        "LGPL-2.1": [*_gnu("Lesser ", "2.1", _SEE), *_gnu("Lesser ", "2.1", _WRITE), _text("LGPL-2.1")],
        "LGPL-3.0": [*_gnu("Lesser ", "3", _SEE), _text("LGPL-3.0")],
        "MIT": [_text("MIT"), "The MIT License (MIT) " + _text("MIT")],
        "MPL-2.0": [mozilla, _text("MPL-2.0")],
        "Unlicense": [_text("Unlicense")],
    }
    for license_id, name in _NAMES.items():
        out[license_id] += [sentence.format(name) for sentence in _NAMED]
    return {k: tuple(v) for k, v in out.items()}
