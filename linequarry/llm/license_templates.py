"""Wording of public licences and of notices that name them, notices of other licences, sentences that only sound alike, and the words that tell where to look."""

TEMPLATES = {
    "MIT": [
        "License: MIT",
        "MIT licensed",
        "MIT OR Apache-2.0",
        "Apache-2.0 OR MIT",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "This software is distributed under the MIT License, see the LICENSE file.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Apache License 2.0",
        "Apache License, Version 2.0",
        "Apache 2.0 license",
        "License: Apache-2.0",
        "Apache License v2.0",
        "Licensed under Apache 2.0",
        "MIT OR Apache-2.0",
        "Apache-2.0 OR MIT",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "Released under the Apache License 2.0.",
        "This project is licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "GNU General Public License",
        "GNU GPL",
        "GPLv3",
        "GPLv2",
        "GPL v3",
        "GPL v2",
        "GPL license",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-3.0",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Released under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see www.gnu.org licenses.",
    ],
    "LGPL": [
        "GNU Lesser General Public License",
        "GNU LGPL",
        "LGPL license",
        "LGPL v2.1",
        "LGPL v3",
        "SPDX-License-Identifier: LGPL-2.1",
        "SPDX-License-Identifier: LGPL-3.0",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU Lesser General Public License v2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "BSD license",
        "BSD-style license",
        "BSD 3-Clause",
        "BSD 2-Clause",
        "3-clause BSD license",
        "2-clause BSD license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "This project is licensed under the terms of the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "Mozilla Public License",
        "MPL 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org.",
    ],
    "CC-BY": [
        "CC BY 4.0",
        "CC BY 3.0",
        "Creative Commons Attribution 4.0",
        "Creative Commons Attribution License",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution License.",
    ],
    "CC-BY-SA": [
        "CC BY-SA",
        "Creative Commons Attribution-ShareAlike",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "CC BY-NC",
        "Creative Commons Attribution-NonCommercial",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC0": [
        "CC0 1.0",
        "CC0 license",
        "SPDX-License-Identifier: CC0-1.0",
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "ISC": [
        "ISC License",
        "License: ISC",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "The Unlicense",
        "License: Unlicense",
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
        "This document is confidential and proprietary and may not be copied or disclosed without prior written consent.",
    ],
}

LOOKALIKES = [
    "He renewed his driving license at the office before the end of the month.",
    "The car had no license plate and was parked in the public square.",
    "Researchers at MIT published a paper about the motion of small particles.",
    "The Apache were known for their skill on horseback in the dry hills.",
    "The general public was not allowed to use the path in winter.",
    "She asked for permission to leave the room and take a copy of the list.",
    "The software is distributed on disks and sold in any form you like.",
    "The restaurant lost its liquor license after several warnings.",
    "Version 2.0 of the game was released under a new name.",
    "A creative class in the commons room is open to the public at 4.0 pm.",
    "Poets have a license to bend the language as they see fit.",
    "The warranty of the washing machine covers all parts for two years.",
    "No part of the town was spared and all rights of way were closed.",
    "You may obtain a copy of the timetable at the station without fee.",
]

#: Notices of licences that are no class here.
OTHERS = [
    "Distributed under the Boost Software License, Version 1.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the GNU Affero General Public License, version 3.",
    "You should have received a copy of the GNU Affero General Public License along with this program.",
    "This software is provided 'as-is', without any express or implied warranty, under the zlib license.",
    "Released under the Artistic License 2.0.",
    "Licensed under the Open Database License.",
    "Licensed under the European Union Public License.",
    "Distributed under the PostgreSQL License.",
    "Released under the SIL Open Font License, Version 1.1.",
    "Licensed under the Python Software Foundation License Version 2.",
    "This file is licensed under the terms of the Common Development and Distribution License.",
    "Licensed under the Business Source License 1.1.",
    "Released under the Academic Free License version 3.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: AGPL-3.0-only",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: BSL-1.0",
]

#: Every template holds one of these; a paragraph that holds none is not scored. Other spellings of a word are words of their own.
GATE = (
    "license licensed licenses licensing licence licenced licences copyright copyrighted spdx gpl gplv gnu lgpl apache bsd mozilla mpl cc isc unlicense unencumbered "
    "redistribution redistributions permission permitted warranty warranties reserved proprietary confidential waived commons sharealike noncommercial compile"
).split()
