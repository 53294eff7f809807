"""Licence notices in wordings that the operator's table does not have, and texts about licences that are none."""

UNSEEN = [
    ("mit", "The MIT License applies to this package"),
    ("mit", "You can use this module under the terms of the MIT License"),
    ("mit", "Distributed under the MIT License, see the file LICENSE"),
    ("apache-2.0", "This module is made available under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License 2.0 governs the use of these files"),
    ("apache-2.0", "Published under the terms of the Apache License Version 2.0"),
    ("bsd", "Use of this source is governed by the BSD 3-Clause License"),
    ("bsd", "The package is under the 3-Clause BSD License"),
    ("gpl-3.0", "Released under the GNU General Public License version 3 or later"),
    ("gpl-3.0", "You may share it under version 3 of the GNU General Public License"),
    ("gpl-2.0", "Released under the GNU General Public License, version 2, or any later one"),
    ("gpl-2.0", "GNU General Public License version 2 applies"),
    ("lgpl", "Distributed under the GNU Lesser General Public License"),
    ("lgpl", "The Lesser General Public License applies to this library"),
    ("agpl-3.0", "You may run it under the GNU Affero General Public License version 3"),
    ("agpl-3.0", "Affero General Public License version 3 applies here"),
    ("mpl-2.0", "These files are under the Mozilla Public License 2.0"),
    ("mpl-2.0", "Mozilla Public License applies to the source code form"),
    ("cc-by-4.0", "Text available under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "You may reuse the article under CC BY 4.0"),
    ("cc-by-sa-4.0", "Content is available under the Creative Commons Attribution-ShareAlike License"),
    ("cc-by-sa-4.0", "Images under CC BY-SA 4.0 unless noted"),
    ("cc-by-nc-4.0", "Shared under a Creative Commons Attribution-NonCommercial License"),
    ("cc-by-nc-4.0", "The photos are CC BY-NC 4.0"),
    ("cc0", "The author has waived all copyright with CC0 1.0"),
    ("unlicense", "This is free and unencumbered software, given to the public domain"),
    ("isc", "The package is under the ISC License"),
    ("bsl-1.0", "Boost Software License Version 1.0 applies"),
    ("epl-2.0", "Made available under the Eclipse Public License 2.0"),
    ("cddl", "Covered by the Common Development and Distribution License"),
    ("eupl-1.2", "Use it under the EUPL, version 1.2"),
    ("artistic-2.0", "You can use it under the Artistic License 2.0"),
    ("ofl-1.1", "The typeface is under the SIL Open Font License 1.1"),
    ("odbl-1.0", "The data are under the Open Database License"),
    ("public-domain", "The map has been dedicated to the public domain"),
    ("proprietary", "Proprietary and confidential, do not copy, all rights reserved"),
]

OTHER = [
    "You need a driving licence to rent a car here",
    "The general public is invited to the opening of the library",
    "Version 2.0 of the plan was rejected by the foundation",
    "The software was released in March and is free for students",
    "Permission to enter the building is granted by the porter",
    "He licensed the song to a film studio and was paid",
    "The apache helicopters flew over the common",
    "All members have the right to vote in the domain of the club",
    "The eclipse was visible for any person in the northern states",
    "Mozilla is a foundation with a long history",
]
