"""Notices, headers, titles and main sentences of well-known licences, by the name that a match returns.

Names in lower case stand for a sentence that several licences or versions share; they sort behind the exact ones.
"""

from __future__ import annotations

# fixed values: notices of well-known licences
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-title": "The MIT License (MIT)",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MIT-condition": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "mit-liability": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License."
    ),
    "Apache-2.0-warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Apache-2.0-grant": (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, "
        "publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or "
        "Object form."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-3-or-4-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "BSD-4-Clause-acknowledgement": (
        "All advertising materials mentioning features or use of this software must display the following acknowledgement:"
    ),
    "bsd-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED."
    ),
    "ISC": "Released under the ISC License.",
    "ISC-licensed": "This project is licensed under the ISC License.",
    "ISC-title": "ISC License",
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "0BSD-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted."
    ),
    "isc-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-2.0-preamble": "The licenses for most software are designed to take away your freedom to share and change it.",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-3.0-preamble": (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works."
    ),
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0-preamble": (
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU "
        "General Public License, supplemented by the additional permissions listed below."
    ),
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "AGPL-3.0-preamble": (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software."
    ),
    "gnu-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-licensed": "Licensed under the Mozilla Public License, version 2.0.",
    "MPL-2.0-copy": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MPL-1.1": (
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use '
        "this file except in compliance with the License."
    ),
    "EPL-1.0": "Licensed under the Eclipse Public License, version 1.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License, version 2.0.",
    "EPL-1.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
        "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"
    ),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "EPL-1.0-title": "Eclipse Public License - v 1.0",
    "EPL-2.0-title": "Eclipse Public License - v 2.0",
    "epl-terms": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-grant": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Unlicense-licensed": "Released under the Unlicense.",
    "CC0-1.0": "Licensed under CC0 1.0.",
    "CC0-1.0-long": "This work is licensed under a Creative Commons Zero v1.0 Universal License.",
    "CC0-1.0-title": "Creative Commons CC0 1.0 Universal",
    "CC0-1.0-deed": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his "
        "or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the "
        "extent allowed by law."
    ),
}
for _n in "234":
    NOTICES[f"BSD-{_n}-Clause"] = f"Released under the BSD {_n}-Clause License."
    NOTICES[f"BSD-{_n}-Clause-licensed"] = f"This project is licensed under the BSD {_n}-Clause License."
    NOTICES[f"BSD-{_n}-Clause-title"] = f"BSD {_n}-Clause License"
NOTICES["bsd"] = "Released under the BSD License."
NOTICES["bsd-licensed"] = "This project is licensed under the BSD License."
for _name, _long, _what, _versions in (
    ("GPL", "GNU General Public License", "program", ("1", "2", "3")),
    ("LGPL", "GNU Lesser General Public License", "library", ("2.1", "3")),
    ("LGPL", "GNU Library General Public License", "library", ("2",)),
    ("AGPL", "GNU Affero General Public License", "program", ("3",)),
):
    for _v in _versions:
        _key = f"{_name}-{_v}" + ("" if "." in _v else ".0")
        _free = f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the {_long}"
        NOTICES[_key] = f"This work is licensed under the {_long}, version {_v}."
        NOTICES[f"{_key}-licensed"] = f"Licensed under the {_long}, version {_v}."
        NOTICES[f"{_key}-header"] = (
            f"{_free} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) "
            "any later version."
        )
        NOTICES[f"{_key}-only"] = f"{_free} version {_v} as published by the Free Software Foundation."
for _short, _long in {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    for _v, _where in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        NOTICES[f"CC-{_short}-{_v}"] = f"Licensed under CC {_short} {_v}."
        NOTICES[f"CC-{_short}-{_v}-long"] = f"This work is licensed under a Creative Commons {_long} {_v} {_where} License."
