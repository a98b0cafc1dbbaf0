"""Public licence texts as templates: fixed values, one entry per paragraph or notice.

Paragraphs are entries of their own, because names, years and line breaks between them differ from file to file.
Each entry has a label, a mandatory key phrase and the text; texts are compared as words. Names and identifiers are
entries too, each its own key phrase.
"""

#: label: names and identifiers (fixed values)
NAMES = {
    "apache-2.0": ("Apache License 2.0", "Apache-2.0 License", "SPDX-License-Identifier: Apache-2.0"),
    "gpl-2.0": ("GNU GPL v2", "GNU GPLv2", "GPL version 2", "SPDX-License-Identifier: GPL-2.0"),
    "gpl-3.0": ("GNU GPL v3", "GNU GPLv3", "GPL version 3", "SPDX-License-Identifier: GPL-3.0"),
    "lgpl": ("GNU LGPL", "SPDX-License-Identifier: LGPL"),
    "agpl": ("GNU AGPL", "SPDX-License-Identifier: AGPL"),
    "mit": ("MIT License", "SPDX-License-Identifier: MIT"),
    "bsd-2-clause": ("BSD 2-Clause", "2-clause BSD"),
    "bsd-3-clause": ("BSD 3-Clause", "3-clause BSD"),
    "isc": ("ISC License", "SPDX-License-Identifier: ISC"),
    "zlib": ("zlib License", "SPDX-License-Identifier: Zlib"),
    "mpl-2.0": ("MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License version 2.0"),
    "epl": ("EPL 2.0", "EPL 1.0"),
    "cc-by-sa": ("CC BY-SA",),
    "cc0": ("CC0 1.0",),
    "unlicense": ("SPDX-License-Identifier: Unlicense",),
    "bsl-1.0": ("Boost Software License", "SPDX-License-Identifier: BSL-1.0"),
    "postgresql": ("PostgreSQL License",),
}

#: (label, key phrase, text)
TEXTS = (
    ("apache-2.0", "apache license version 2", "licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "in compliance with the license",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    ),
    (
        "apache-2.0",
        "governing permissions and limitations",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ),
    ("gpl-2.0", "general public license version 2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "general public license version 3", "licensed under the GNU General Public License, version 3"),
    (
        "gpl-2.0",
        "either version 2 of the license",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ),
    (
        "gpl-3.0",
        "either version 3 of the license",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    (
        "gpl",
        "see the gnu general public license for more details",
        """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    ("lgpl", "lesser general public license", "licensed under the GNU Lesser General Public License"),
    (
        "lgpl",
        "gnu lesser general public license as published",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the
        Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ),
    ("agpl", "affero general public license", "licensed under the GNU Affero General Public License"),
    (
        "agpl",
        "gnu affero general public license as published",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    (
        "mit",
        "hereby granted free of charge",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software""",
    ),
    (
        "mit",
        "without restriction including without limitation the rights",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    ),
    (
        "mit",
        "publish distribute sublicense",
        """in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software""",
    ),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the Software"),
    (
        "mit",
        "permission notice shall be included in all copies",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "mit",
        "fitness for a particular purpose and noninfringement",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    ),
    ("bsd", "source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "bsd",
        "source and binary forms",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    ),
    (
        "bsd-3-clause",
        "may be used to endorse or promote products",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    ),
    (
        "bsd",
        "provided by the copyright holders and contributors",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
        OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    ),
    ("isc", "use copy modify and or distribute", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    (
        "isc",
        "with or without fee is hereby granted",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "isc",
        "the author disclaims all warranties",
        """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        "must not be misrepresented",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
        the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
        wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
        required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
        not be removed or altered from any source distribution.""",
    ),
    (
        "zlib",
        "altered source versions must be plainly marked",
        """Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
        not be removed or altered from any source distribution.""",
    ),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mpl-2.0",
        "mozilla public license",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    ("epl", "eclipse public license", "made available under the terms of the Eclipse Public License"),
    (
        "epl",
        "eclipse public license",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/""",
    ),
    ("cc-by-sa", "attribution sharealike", "Creative Commons Attribution-ShareAlike License"),
    ("cc-by-4.0", "cc by 4 0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "commons attribution 4 0 international", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "public domain dedication", "CC0 1.0 Universal public domain dedication"),
    (
        "cc0",
        "waived all copyright and related",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    ),
    (
        "unlicense",
        "unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain.",
    ),
    (
        "unlicense",
        "compile sell or distribute this software",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    ),
    (
        "bsl-1.0",
        "to any person or organization obtaining a copy",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software,
        and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    ),
    (
        "postgresql",
        "without a written agreement is hereby granted",
        """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is
        hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.""",
    ),
)
