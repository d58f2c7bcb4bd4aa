"""Licence texts and notices that :mod:`helixlake.llm.licenses` knows; callers may bring their own table.

Fixed values: the wording of public licences.
"""

_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CLAUSES_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_GRANT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Titles that a text may have on a line of its own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"],
    "Zlib": ["zlib License", "The zlib License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
}

#: (licence, text) of whole texts without their titles.
_TEXTS: list[tuple[str, str]] = [
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY_MIT,
    ),
    ("ISC", _GRANT_ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC),
    ("0BSD", _GRANT_ISC + ".\n" + _WARRANTY_ISC),
    ("BSD-2-Clause", _CLAUSES_BSD + _WARRANTY_BSD),
    (
        "BSD-3-Clause",
        _CLAUSES_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.\n" + _WARRANTY_BSD,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
        "all subject to the following:\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a "
        "source language processor.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE '
        "AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

#: (licence, line) of notices that stand on a line of their own.
_NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: (licence, text), whole texts with and without a title and notices.
KNOWN: list[tuple[str, str]] = [*_TEXTS, *((name, f"{title}\n{text}") for name, text in _TEXTS for title in TITLES.get(name, [])), *_NOTICES]

#: (licence, digest of its canonical text) of longer whole texts as commonly distributed, some with and without an appendix.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "1210a794ee9c5ec1b9b9563e0c49b2e5dae22cb7aae677c56a3beeb613d47838"),
    ("Apache-2.0", "272ff21c52fb7967453241cc09147a1dfcb4552355904fa7864f2364a32114fd"),
    ("Apache-2.0", "4037172c67889accd9129ee08548be202a5ee97c1c74766c2078b10586462c71"),
    ("Apache-2.0", "7bea06fccfc24430435c268e34d3f6bf83047a15bba121f72721203ce4d411e4"),
    ("Apache-2.0", "9cb0a96f3d7f70c793d2f9859eadcc3558d7e79276b6ffe1b803b154dbe1a769"),
    ("Apache-2.0", "a4412992302ca9a7da85aa9168e695c28668b7140a7e7fa559caa582141aedf1"),
    ("Apache-2.0", "fc972778b4f997bc1d3cd1563b2c26cd582c583ef503ce10db8b718fbc030a1b"),
    ("Artistic-1.0", "3088f8cc496d6d0d45c610c6dfefbe927d60c5c8cd039cebb94c51c00d1798b4"),
    ("BlueOak-1.0.0", "f3debb427d3f3698038a86d6d7e50586ae7147d0a987db6d9f9128e09235efbf"),
    ("CC0-1.0", "453394e4cd36379c611c6e2427ab394975ec8d7b919ef9acbd0c24d78f3f136e"),
    ("GFDL-1.2", "d5b41bc34f83bf08f0d13fb25e8be7da5e6763d67b1feb337675bbc7ae72a046"),
    ("GFDL-1.3", "87e6d6e07f98564ffcfb6bd51621c881a95607eb4399b35208b3f21f8465e112"),
    ("GPL-1.0", "a91269a7d671478bb334839d18fa2cc2aaf7dc1c50b97c8f70102afad8822156"),
    ("GPL-2.0", "7984f14b8ed4f9f943cb2b353627c5c0aed9bb5e166e7c8221c4dfdb75e436ec"),
    ("GPL-3.0", "23c9074c0773360f77b7f1af6749f41bd273803600cbea6977f1567af6d93c43"),
    ("LGPL-2.0", "e59b4bd6792b8cc03455a4c0625581f7943a5d5bdd614781629acf0b87097afc"),
    ("LGPL-2.1", "ec9f0aadb92eece5ba581c2f9d72c1b41bf46acc146ddf2937b4943832bb250c"),
    ("LGPL-3.0", "d018c7b199681f52bb188e25de97e8bc7539b0ae44f7b7e5d2bc870b25b598bd"),
    ("MPL-1.1", "2d31331685503d07337e1d4dc5c78687f8c1d5f894060315626c39105c09cd24"),
    ("MPL-2.0", "bf96c5309c0115505b8c6596b6e18021848f4098e002b5ee1949f168b9c225e0"),
    ("Unlicense", "a782c22f8697e5f699413daf99a70bd246f9de384f146da06c45810ba5528696"),
]
