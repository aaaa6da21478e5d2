"""Words of licence notices that the licence scan looks for. Texts are split into words as the scan splits files."""

from __future__ import annotations

#: Phrases that count at every place, with their labels.
BASE = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]

#: Label, wording of the notice, phrases that must stand in it.
NOTICES = [
    ("mit", "released under the MIT License", ["mit license"]),
    ("mit", "licensed under the terms of the MIT license", ["mit license"]),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["free of charge to any person obtaining a copy"],
    ),
    ("apache-2.0", "licensed under the Apache License version 2.0", ["apache license", "2 0"]),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at",
        ["apache license", "except in compliance with the license"],
    ),
    ("gpl-2", "licensed under the GNU General Public License version 2", ["general public license", "version 2"]),
    ("gpl-3", "licensed under the GNU General Public License version 3", ["general public license", "version 3"]),
    (
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version",
        ["gnu general public license", "version 2"],
    ),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
        ["gnu general public license", "version 3"],
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License", ["affero general public license"]),
    ("cc-by", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike 4 0"]),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0"]),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
        ["mozilla public license", "2 0"],
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        ["source and binary forms"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee"],
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software",
        ["provided as is"],
    ),
    (
        "bsl-1.0",
        "Boost Software License - Version 1.0 Permission is hereby granted, free of charge, to any person or organization "
        "obtaining a copy of the software and accompanying documentation covered by this license",
        ["person or organization obtaining a copy"],
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
]
