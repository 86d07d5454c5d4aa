"""Examples that tell prose from licence text and from banners of generators and tools.

The model of sentence kinds (reading.train_kinds) is fitted on these sentences, on the labelled
passages (prose) and on the sentences of the corpus's own licence files (a bounded sample), so
that what counts as a licence or a banner follows from a sentence's words as a whole and from the
sentences around it, never from a single word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROSE, LICENCE, BANNER = 0, 1, 2
MAX_LICENCES = 200

# Ordinary sentences, many with words that licences and banners use as well.
PROSE_EXAMPLES = """
The nightly report is generated by the server.
It is read by every person in the office.
We like it because it is short.
The story of the map is told by an old sailor.
She wrote a book about copyright and the people who break it.
The history of copyright begins with the printing press.
Copyright is a branch of law that protects writers and painters.
The teacher told the class about copyright and trademarks.
Our lawyers wrote a long letter about the licence of the name.
The author of the novel never asked for permission.
The court decided that the copyright of the song belongs to the singer.
The storm did great damage to the bridge under such conditions.
The damage was small and the owners were lucky.
Each client generates a token and sends it to the server.
A new key is generated every time the user signs in.
The tests generate random values so that errors come to light.
The chart is produced by the program from the raw numbers.
The milk is produced by three farms in the valley.
Put the task on your todo list and come back later.
Our todo list has two more items for this week.
You can edit the file with any editor and save the changes.
Do not edit the entry while another person reads it.
Changes take effect when the service starts again.
If the disk is full the last messages will be lost.
Messages that arrive late will be lost unless they are kept in a queue.
The value is overwritten when the next reading arrives.
The old file will be overwritten by the copy command.
The terms of the sum are added from left to right.
Every term in the series is smaller than the one before.
The user has the right to read the folder but not to write to it.
Rights are checked before the request is granted.
Access is granted when the password is correct.
The lock is granted to the first thread that asks for it.
Permission to read the file is checked by the system.
The makers of the clock used gears of brass.
Contributors should run the tests before they send a patch.
Please send a notice to the team when you change the schema.
The notice on the door says that the shop is closed.
The clause after the keyword is evaluated only once.
A where clause filters the rows before they are grouped.
The conditions of the loop are tested at the end.
The licence number of the car is stored in the second column.
Drivers need a licence before they may use the road.
The license server answers with the number of free seats.
The function returns true if the license key is valid.
The supplied argument must not be negative.
The supplied function is called for every row.
The copies are written to three nodes.
Two copies of the block are kept on different disks.
The work is distributed over all the workers.
The original work of the painter hangs in the museum.
The source code is compiled before it is run.
In its compiled form the program is much smaller.
The parser is written in plain code and has no state.
This class holds the state of a connection.
This method returns the number of items in the list.
This is the main file of the project.
This is a small text file.
This is an old file that nobody reads.
This file describes how the cache works.
The module reads the settings and opens the store.
The warranty of the machine ends after two years.
The company is liable for the loss of a parcel.
The holder of the lock must release it.
The limits are enforced by the scheduler.
The rules are enforced when the form is sent.
The public domain name of the site points to the proxy.
All rights of the role are listed in the table below.
The tool produced a file that was empty.
The build tool writes the output into a folder.
The linter finds code that is never used.
Run the command again if the first attempt fails.
The quick brown fox jumps over the lazy dog.
Water boils at a lower temperature on a mountain.
Children learn to read by listening to stories.
The government changed the law in spring.
Most birds leave the forest before the winter comes.
""".strip().splitlines()

# Sentences as they stand in notices and licences in public use.
LICENCE_EXAMPLES = """
Copyright 2015 the authors.
Copyright (c) 2001 The project contributors.
Copyright (C) 1998 the copyright holders and contributors.
Copyright 2009 The Authors of this software.
All rights reserved.
All rights not granted in this License are reserved.
Licensed under the Apache License, Version 2.0.
Licensed under the MIT licence; see the LICENSE file.
Licensed under the 3-Clause licence; see the licence file for details.
Licensed under the Creative Commons licence, see the licence file.
Licensed under the terms of the public licence.
This source code is licensed under the terms found in the licence file in the root directory.
See the LICENSE file for the terms of use.
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
You may not use this file except in compliance with the License.
You may obtain a copy of the License at the address below.
See the License for the specific language governing permissions and limitations under the License.
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction.
Permission to use, copy, modify and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.
Permission is granted to copy, distribute and modify this document under the terms of the free documentation license.
Permission is granted to make and distribute verbatim copies of this manual provided the copyright notice is preserved.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.
The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability and fitness for a particular purpose.
In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.
The work is provided as it is, without guarantees, and the licensor is not liable for any loss or damage arising from its use.
The licensor offers the work as it is and makes no representations or warranties of any kind concerning the work.
The software is supplied as it is, and the makers accept no responsibility for it.
The work is free of any warranty, and the copyright holders accept no liability for it.
The authors accept no liability for the work or for any consequence of its use.
Permission to copy and distribute this document without restriction is granted.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice in the documentation.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
This notice may not be removed or altered from any source distribution.
Each contributor hereby grants to you a perpetual, worldwide, royalty-free copyright license to reproduce and distribute the work.
This License does not grant permission to use the trade names, trademarks or marks of the licensor.
This program is free software; you can redistribute it and modify it under the terms of the licence as published by the foundation.
This program is distributed in the hope that it will be useful, but without any warranty, without even the implied warranty of merchantability.
You should have received a copy of the licence along with this program.
If any provision of this licence is held to be unenforceable, the remaining provisions shall stay in full force and effect.
You may convey verbatim copies of the source code provided that you keep intact all notices.
Your rights under these terms end if you fail to comply with any of the conditions.
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell or distribute this software, either in source code form or as a compiled binary.
""".strip().splitlines()

# Banners of generators and notes to tools, as sentences.
BANNER_EXAMPLES = """
Code generated by the protocol compiler, do not edit.
Code generated by mock; DO NOT EDIT.
This file was generated by the compiler.
This file was automatically generated by the build tool.
This file was produced by the code generator.
This file is generated, do not edit it by hand.
This file has been produced by a tool.
This is a generated file, please do not modify it.
This code was generated by a tool.
Automatically generated by the schema compiler.
Generated by the parser generator from the grammar.
Generated from the source template, do not edit.
Do not edit this file.
Do not edit this file by hand.
Do not edit by hand, all changes will be lost.
Do not modify this file manually.
Any changes to this file will be lost.
Changes will be lost.
Changes made here will be lost when the code is regenerated.
Manual changes will be overwritten.
Your edits will be overwritten when the file is generated again.
Changes to this file may cause incorrect behavior and will be lost if the code is regenerated.
Edit the template and run the generator again instead of this file.
This file was produced by the exporter and must not be changed.
TODO fix this.
TODO remove this when the old parser is gone.
FIXME this is a hack.
""".strip().splitlines()


def is_licence_file(path: Column, license_path: Column) -> Column:
    """Whether a path is its repository's licence file, or named like one."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.coalesce(path == license_path, F.lit(False)) | F.coalesce(F.substring_index(name, ".", 1).isin("license", "licence", "copying"), F.lit(False))


def licence_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "path", license_path: str = "license_path", limit: int = MAX_LICENCES) -> list[str]:
    """Distinct texts of the first ``limit`` licence files by id: the sample that the kinds are fitted on.

    The ids are picked from the narrow columns alone; then only these documents' texts are read.
    """
    picked = docs.where(is_licence_file(F.col(path), F.col(license_path)) & F.col(doc_id).isNotNull()).select(doc_id).orderBy(doc_id).limit(limit)
    ids = [r[0] for r in picked.collect()]
    return sorted({r[0] for r in docs.where(F.col(doc_id).isin(ids)).select(text).collect() if r[0]}) if ids else []
