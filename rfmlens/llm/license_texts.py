"""Known licences besides ``licenses.KNOWN``: file headers, SPDX tags, and canonical digests of full texts.

The digests are those of ``licenses.digests`` over the texts that Debian ships in /usr/share/common-licenses (with and without the part on how
to apply the licence, with the present, the former or no address of its publisher) and over CC BY 4.0. Headers are paragraphs of the usual notices.
"""

HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed "
                   "with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache "
                   "License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of "
                   "the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://www.mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to "
                "the public domain worldwide. This software is distributed without any warranty."),
    *[(f"{short}-{number}", f"{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
                            f"the Free Software Foundation{clause}")
      for short, name, number, version in [
          ("GPL", "General Public License", "1.0", "1"), ("GPL", "General Public License", "2.0", "2"), ("GPL", "General Public License", "3.0", "3"),
          ("LGPL", "Library General Public License", "2.0", "2"), ("LGPL", "Lesser General Public License", "2.1", "2.1"),
          ("LGPL", "Lesser General Public License", "3.0", "3"), ("AGPL", "Affero General Public License", "3.0", "3")]
      for what in ("This program", "This library", "This file", "This software")
      for clause in (f"; either version {version} of the License, or (at your option) any later version.", f", version {version}.",
                     f"; version {version} of the License.", f", version {version} of the License.", f"; version {version}.")],
]
TAGS = {
    **{x: [x] for x in """MIT ISC 0BSD BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-1.1 MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0
        Artistic-1.0""".split()},
    **{x: [x, f"{x}-only", f"{x}-or-later"] for x in "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 GFDL-1.2 GFDL-1.3".split()},
}
SPDX = [(name, f"SPDX-License-Identifier: {tag}") for name, tags in TAGS.items() for tag in tags]
DIGESTS = [
    ("Apache-2.0", "536268a29a0159e67af17c6e67180c66dd3d63b55f1de711e05c122be8002289"),
    ("Apache-2.0", "94ab2db69513be8875470e3a4d39d5a437c91da93f172411d69d7552938f539a"),
    ("Apache-2.0", "e31ac59f164ccf53aa974b50f93c9ea55654552a7beb0de32efa0ddda78b04a9"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC-BY-4.0", "2ada4983f8ef521d40067fd60693a47d84d267707d442b46bfe0fa22353f8a78"),
    ("CC-BY-4.0", "2db062dd40e7bec05f856fa75834d18d15b06014d537775860dd1f054a5f0389"),
    ("CC-BY-4.0", "e73b14644bff17658d10b651b24b4e872f63d7513c447933fad53666a196df8e"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.2", "8d08c74cec4dc000cf7c1c2967e04c1f2cfbb7b005c9db69c29b0fa77e4da921"),
    ("GFDL-1.2", "8e2a709e38f777cdad4fef08ae7c15506d92bc64ce471e44d7d46055daa80704"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "37a8d6ceffb74a4cd60be1028e4d7d9cc0b1682c4aa3c1d9efd628dc5460f60b"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d"),
    ("GPL-1.0", "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1"),
    ("GPL-1.0", "9b80eb3145b87968fde482b384ff47a39c81a9f3f04b7b569a2876c47d7ebdf8"),
    ("GPL-1.0", "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697"),
    ("GPL-1.0", "d98bca1875592c382caba655043aec268528bc17c9d7c0a9e892b953378effa6"),
    ("GPL-2.0", "17bc27c667a8d82915bb74a167975daaa34a72ef983dffc60903e06b043338ba"),
    ("GPL-2.0", "34cacbc5d4c8288f220e8dfade5276e6f76704f67150b4388c9ed3e3ff88cd90"),
    ("GPL-2.0", "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25"),
    ("GPL-2.0", "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "f1412332f5361d2a392bb637c3844ed3a32b7d701ac0e7abacce50b34a9a3afb"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2"),
    ("LGPL-2.0", "3c503e1843d56bee44590ba959b2a745cf954688aa5dd285043d139d8c3e6cd6"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "96c47047421b3be5cae9a68c75f37fdcf07945fba0a1d6db6a3b57f9c70f75a0"),
    ("LGPL-2.0", "cf38cfc729861170868078065b856d3242fe7a850766def057d000a16c81b436"),
    ("LGPL-2.0", "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "9862e738f315d8a5309bc010439dcb015ff90374b4007a59d5b00e12f9642e8f"),
    ("LGPL-2.1", "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47"),
    ("LGPL-2.1", "a6742add8db4ff9ba6917da0bd1f95927436acfd65ae81933f1e9a859d38d9fa"),
    ("LGPL-2.1", "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "d00d08192018b2217de04b223449941a18a7cb07d0c025393948065a12eb0fb2"),
    ("LGPL-2.1", "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "8f0473f9c917c507827dca355168119bb065ca1a9dab0e366988bcdba5fa039b"),
]
