"""Licence texts and notices that the licence scan knows by default. All of this file is fixed values, as text."""

# label: (text, mandatory key phrases); longer licences by the notice that files carry, or by their opening.
TEXTS = {
    "mit-text": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["permission is hereby granted free of charge", "this permission notice shall be included"],
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of",
        ["permission is hereby granted free of charge to any person"],
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
        IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS.""",
        ["permission to use copy modify", "with or without fee is hereby granted"],
    ),
    "bsd-2-clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce"],
    ),
    "bsd-3-clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
        ["redistribution and use in source and binary forms", "neither the name of", "endorse or promote products derived from this software"],
    ),
    "apache-2.0-notice": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ["apache license version 2 0", "except in compliance with the license"],
    ),
    "gpl-2.0-notice": (
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        ["gnu general public license as published by the free software foundation", "version 2"],
    ),
    "gpl-3.0-notice": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        ["gnu general public license as published by the free software foundation", "version 3"],
    ),
    "lgpl-notice": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.""",
        ["gnu lesser general public license as published by the free software foundation"],
    ),
    "agpl-3.0-notice": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.""",
        ["gnu affero general public license as published by the free software foundation"],
    ),
    "mpl-2.0-notice": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ["mozilla public license v 2 0"],
    ),
    "epl-2.0-notice": (
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which
        is available at https://www.eclipse.org/legal/epl-2.0/""",
        ["eclipse public license"],
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
        ["free and unencumbered software released into the public domain"],
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented.""",
        ["permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"],
    ),
    "bsl-1.0": (
        """Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or
        organization obtaining a copy of the software and accompanying documentation covered by this license""",
        ["boost software license"],
    ),
    "cc0-1.0-notice": (
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
        This work is dedicated to the public domain under CC0 1.0 Universal.""",
        ["cc0 1 0"],
    ),
    "cc-by-4.0-text": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4 0"]),
    "cc-by-sa-4.0-text": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["creative commons attribution sharealike"]),
    "cc-by-nc-4.0-text": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["creative commons attribution noncommercial 4 0"]),
    "gfdl-notice": (
        """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation
        License, Version 1.3 or any later version published by the Free Software Foundation""",
        ["gnu free documentation license"],
    ),
}
# label: phrase; the phrase is its own key phrase.
CITATIONS = {
    "gpl-2.0": "GNU General Public License, version 2",
    "gpl-3.0": "GNU General Public License, version 3",
    "lgpl": "GNU Lesser General Public License",
    "agpl": "GNU Affero General Public License",
    "apache-2.0": "Apache License, Version 2.0",
    "mit-release": "released under the MIT License",
    "bsd-release": "released under the BSD License",
    "mpl-2.0": "Mozilla Public License 2.0",
    "cc-by-4.0": "CC BY 4.0",
    "cc-by-sa": "CC BY-SA",
    "cc-by-nc": "CC BY-NC",
    "cc-by-nd": "CC BY-ND",
    "cc0": "CC0 1.0",
    "all-rights-reserved": "all rights reserved",
}
# (label, reference, mandatory key phrases): short references that name a licence in another order or form; None: the reference itself.
REFERENCES = [
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation version 2", ["gnu general public license as published by the free software foundation", "version 2"]),
    ("gpl-3.0", "GNU General Public License as published by the Free Software Foundation version 3", ["gnu general public license as published by the free software foundation", "version 3"]),
    ("gpl-2.0", "GNU GPL version 2", None),
    ("gpl-3.0", "GNU GPL version 3", None),
    ("gpl-2.0", "GPL v2", None),
    ("gpl-3.0", "GPL v3", None),
    ("gpl-2.0", "GPLv2", None),
    ("gpl-3.0", "GPLv3", None),
    ("lgpl", "LGPLv3", None),
    ("agpl", "AGPLv3", None),
    ("apache-2.0", "Apache License 2.0", None),
    ("apache-2.0", "Apache 2.0 license", None),
    ("apache-2.0", "Apache 2.0 licence", None),
    ("apache-2.0", "Apache 2.0 licensed", None),
    ("apache-2.0", "licensed under Apache 2.0", None),
    ("mit-release", "MIT licensed", None),
    ("mit-release", "MIT licence", None),
    ("mit-release", "license MIT", None),
    ("mit-release", "licence MIT", None),
    ("mit-release", "licensed under MIT", None),
    ("bsd-release", "BSD licensed", None),
    ("bsd-2-clause", "BSD 2-Clause License", None),
    ("bsd-3-clause", "BSD 3-Clause License", None),
    ("cc-by-4.0", "Creative Commons Attribution 4.0", None),
]
# Identifiers of the tag "SPDX-License-Identifier".
SPDX = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "Zlib", "BSL-1.0"]
