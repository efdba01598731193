"""Usual wordings of licences besides the one-line notices.

``TITLES`` stand on a line of their own, ``HEADERS`` anywhere in a file,
``OPENINGS`` begin licences too long to list, ``TEXTS`` are whole licences.
"""

# Words without which a notice, title or header names no licence.
KEYS = {
    "AGPL-3.0": "affero", "Apache-2.0": "apache", "BSD-2-Clause": "bsd 2", "BSD-3-Clause": "bsd 3",
    "CC-BY-4.0": "by 4", "CC-BY-NC-4.0": "nc 4", "CC-BY-SA-4.0": "sa 4", "CC0-1.0": "cc0", "GPL-2.0": "2",
    "GPL-3.0": "3", "ISC": "isc", "LGPL-3.0": "lesser 3", "MIT": "mit", "MPL-2.0": "mozilla", "Unlicense": "",
}

TITLES = [
    ("AGPL-3.0", "GNU Affero General Public License v3.0"), ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache License Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License version 2"), ("GPL-3.0", "GNU General Public License version 3"),
    ("ISC", "ISC License"), ("LGPL-3.0", "GNU Lesser General Public License version 3"), ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
]


def _gpl(name: str, version: str, program: str = "This program") -> str:
    return (f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
            f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) "
            "any later version.")


HEADERS = [
    ("AGPL-3.0", _gpl("Affero General Public License", "3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License "
     "(CC BY-NC 4.0)."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License "
     "(CC BY-SA 4.0)."),
    ("GPL-2.0", _gpl("General Public License", "2")), ("GPL-3.0", _gpl("General Public License", "3")),
    ("LGPL-3.0", _gpl("Lesser General Public License", "3", "This library")),
    ("MIT", "Licensed under the MIT License."), ("MIT", "Distributed under the terms of the MIT License."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

_VERBATIM = ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is "
             "not allowed.")
_FSF = "Free Software Foundation, Inc."

OPENINGS = [
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 {_FSF} {_VERBATIM}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
     'REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, '
     "and distribution as defined by Sections 1 through 9 of this document."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License By exercising the Licensed Rights (defined "
     "below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 "
     "International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License By exercising the Licensed "
     "Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons "
     "Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License By exercising the Licensed "
     "Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons "
     "Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically "
     "confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s)"),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 {_FSF} {_VERBATIM}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 {_FSF} {_VERBATIM}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 {_FSF} {_VERBATIM}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity "
     "that creates, contributes to the creation of, or owns Covered Software."),
]

_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction,')
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
_LIABLE = ("THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
           "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
           "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
           "DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:")
_BSD_TWO = (" 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
            "of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution. ")
_BSD_THREE = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission. ")
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
            "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
            "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
            "DAMAGE.")

TEXTS = [
    ("BSD-2-Clause", _BSD), ("BSD-2-Clause", _BSD + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THREE + _BSD_END), ("ISC", _ISC),
    ("ISC", _ISC + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
     "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
     "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
     "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
     "THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"), ("MIT", _MIT),
    ("MIT", _MIT + " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software. " + _AS_IS + _LIABLE),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for "
     "any purpose, commercial or non-commercial, and by any means."),
]
