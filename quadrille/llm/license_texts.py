"""Public licence texts and notices, with the phrases that a copy must hold. Fixed values, as published by their authors.

A text is what follows the copyright line. label: (text, mandatory key phrases in the order in which they stand); what follows
a slash in a label tells texts of the same label apart. Case and
punctuation don't count; a phrase is given in words as they are after both are dropped.
"""

from __future__ import annotations

GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
HOLDERS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

TEMPLATES = {
    "mit": (GRANT, ("permission is hereby granted free of charge", "the rights to use copy modify merge publish distribute sublicense", "shall be included in all copies or substantial portions")),
    "mit-notice": ("released under the MIT License", ("mit license",)),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ("for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    "bsd-2-clause": (f"{REDISTRIBUTION} {HOLDERS}", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    "bsd-3-clause": (
        f"{REDISTRIBUTION} {ENDORSEMENT} {HOLDERS}",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "to endorse or promote products derived from this software"),
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
        ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"),
    ),
    "apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
        ("licensed under the apache license version 2 0", "except in compliance with the license", "distributed on an as is basis"),
    ),
    "apache-2.0-notice": ("licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    "gpl-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("the gnu general public license as published by the free software foundation", "version 3 of the license"),
    ),
    "gpl-3.0-notice": ("licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    "gpl-2.0": (
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("the gnu general public license as published by the free software foundation", "version 2 of the license"),
    ),
    "gpl-2.0-notice": ("licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    "gpl-3.0-notice/of": ("under the terms of version 3 of the GNU General Public License", ("version 3 of the gnu general public license",)),
    "gpl-2.0-notice/of": ("under the terms of version 2 of the GNU General Public License", ("version 2 of the gnu general public license",)),
    "lgpl": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation""",
        ("gnu lesser general public license",),
    ),
    "agpl-3.0": (
        """you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
Software Foundation, either version 3 of the License""",
        ("gnu affero general public license",),
    ),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("subject to the terms of the mozilla public license", "a copy of the mpl was not distributed"),
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain", "anyone is free to copy modify publish use"),
    ),
    "wtfpl": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ("do what the fuck you want to public license",)),
    "cc0": ("CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    "cc-by-4.0": ("licensed under CC BY 4.0", ("cc by 4 0",)),
    "cc-by-nc": ("licensed under CC BY-NC 4.0", ("cc by nc",)),
    "cc-by-sa": ("licensed under CC BY-SA 4.0", ("cc by sa",)),
    "cc-by-nd": ("licensed under CC BY-ND 4.0", ("cc by nd",)),
    "cc-by-name": ("licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
}
#: Short identifiers that may follow SPDX_HEAD, and words that join them. Fixed values of a public list, the frequent ones.
SPDX_HEAD = "SPDX-License-Identifier"
SPDX_JOINED = ("or", "and", "with")
SPDX_IDS = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause
BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0
ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC
LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LLVM-exception
LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Unicode-3.0
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
