"""What licences look like: names in statements, notices for file headers, whole short licences, and how long ones begin."""

from __future__ import annotations

# SPDX identifiers and the names by which statements call these licences.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Modified BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License - v 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License, Version 2"],
    "Zlib": ["zlib License"],
}
_KINDS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version, _scope in (("3.0", "Unported"), ("4.0", "International")):
        _long = "-".join(_KINDS[k] for k in _kind.split("-"))
        NAMES[f"CC-{_kind}-{_version}"] = [f"CC {_kind} {_version}", f"Creative Commons {_long} {_version} {_scope} License"]

FORMS = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This project is licensed under the terms of the {}.", "Distributed under the terms of the {}.",
]

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_GNU = (
    "{work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free "
    "Software Foundation, either version {version} of the License, or (at your option) any later version. {work} is distributed in the hope that it will "
    "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}"
    "General Public License for more details."
)
_GNU_HEAD = (
    "GNU {name}GENERAL PUBLIC LICENSE Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and "
    "distribute verbatim copies of this license document, but changing it is not allowed."
)

# Notices that files carry, whole short licences, and the beginnings of long ones.
TEXTS = [
    ("0BSD", f"{_GRANT}. {_NO_WARRANTY_ISC}"),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_NO_WARRANTY_ISC}"),
    ("MIT", f"{_MIT} {_MIT_END}"),
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_END}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
     "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
     "License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. "
     'Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the '
     "creation of, or owns Covered Software."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
     "https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
     'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of '
     "the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
     "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
     "and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that "
     "you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
     "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
     "not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
     "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ"),
]
for _id, _name, _number, _date, _year in (
    ("GPL-2.0", "", "2", "June 1991", "1989, 1991"), ("GPL-3.0", "", "3", "29 June 2007", "2007"), ("LGPL-2.1", "Lesser ", "2.1", "February 1999", "1991, 1999"),
    ("LGPL-3.0", "Lesser ", "3", "29 June 2007", "2007"), ("AGPL-3.0", "Affero ", "3", "19 November 2007", "2007"),
):
    TEXTS.append((_id, _GNU_HEAD.format(name=_name, version=_number, date=_date, year=_year)))
    TEXTS += [(_id, _GNU.format(work=work, name=_name, version=_number)) for work in ("This program", "This library")]


def templates() -> list[tuple[str, str]]:
    """(SPDX identifier, text) of all."""
    named = [(spdx, form.format(name)) for spdx, names in NAMES.items() for name in names for form in FORMS]
    return named + [(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in NAMES] + TEXTS
