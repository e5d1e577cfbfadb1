"""Statements by which licences are named: titles, short forms, standard headers and sentences of licence texts."""

from __future__ import annotations

import re

#: Licence name, full titles.
TITLES = [
    ("AGPL-3.0", "GNU Affero General Public License"),
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Artistic-2.0", "Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("EUPL-1.2", "European Union Public Licence 1.2"),
    ("GPL-1.0-or-later", "GNU General Public License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-2.0-or-later", "GNU Lesser General Public License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("OFL-1.1", "SIL Open Font License, Version 1.1"),
    ("Unlicense", "The Unlicense"),
    ("Zlib", "zlib License"),
]
#: Ways of naming a licence by its title or by its short name.
PHRASES = ["{}", "Licensed under the {}", "Released under the {}", "This project is licensed under the {}",
           "This work is licensed under the {}"]
TAG = "SPDX-License-Identifier: {}"
#: Short names with a phrase of their own.
SHORT = [
    ("AGPL-3.0", "Licensed under the AGPLv3"), ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "Licensed under the GPLv2"), ("GPL-3.0", "Licensed under the GPLv3"),
    ("LGPL-3.0", "Licensed under the LGPLv3"),
]
#: Sentences of standard headers and licence texts.
SENTENCES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
            'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
            'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the '
            'Software is furnished to do so, subject to the following conditions'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
             "and redistribute it freely, subject to the following restrictions"),
    ("proprietary", "All rights reserved"),
]
#: Words that tell licences apart. A statement made from a name counts only where that name stands.
NAMES = ["affero", "agpl", "agplv3", "apache", "artistic", "boost", "bsd", "bsl", "cc", "cc0", "commons", "eclipse", "epl", "eupl",
         "european", "gnu", "gpl", "gplv2", "gplv3", "isc", "lesser", "lgpl", "lgplv3", "mit", "mozilla", "mpl", "ofl", "sil",
         "unlicense", "zlib"]


def terms(statement: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", statement.lower())


def templates() -> list[tuple[str, str]]:
    """(licence, statement), each once: every phrase with every title and short name, tags and sentences."""
    ids = [n for n in dict.fromkeys(n for n, _ in TITLES) if not n.endswith("or-later")]
    short = [(n, p.format(f"{n} License")) for n in ids for p in PHRASES[1:3]]
    tags = [(n, TAG.format(n)) for n in ids] + [
        (n, TAG.format(f"{n}-{end}")) for n in ids if "GPL" in n for end in ("only", "or-later")]
    return list(dict.fromkeys([(n, p.format(t)) for n, t in TITLES for p in PHRASES] + short + tags + SHORT + SENTENCES))


def must(statement: str) -> str | None:
    """The first name in a statement; None where it is told by its wording alone."""
    return next((t for t in terms(statement) if t in NAMES), None)
