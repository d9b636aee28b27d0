"""Catalogue of license templates (operator 7)."""

# Wording of the licenses and of usual references to them, as published by their authors.
# <<opt>>...<</opt>> may be missing; <<any;n>> stands for at most n words of any kind, so for names,
# bullets and addresses. Case and punctuation do not count.

_MIT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the
rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or
substantial portions of the software the software is provided as is without warranty of any kind express or implied
including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall <<any;10>> be liable for any claim damages or other liability whether in an action of contract tort
or otherwise arising from out of or in connection with the software or the use or other dealings in the software
"""

_BSD_GRANT = """
redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met <<any;1>> redistributions of source code must retain the above copyright notice this
list of conditions and the following disclaimer <<any;1>> redistributions in binary form must reproduce the above
copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
provided with the distribution
"""

_BSD_ENDORSEMENT = """
<<any;1>> neither the name of <<any;12>> nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission
"""

_BSD_DISCLAIMER = """
this software is provided by <<any;12>> as is and any express or implied warranties including but not limited to the
implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
<<any;12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not
limited to procurement of substitute goods or services loss of use data or profits or business interruption however
caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
arising in any way out of the use of this software even if advised of the possibility of such damage
"""

_ISC = """
permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is
hereby granted provided that the above copyright notice and this permission notice appear in all copies the software
is provided as is and <<any;10>> disclaims all warranties with regard to this software including all implied
warranties of merchantability and fitness in no event shall <<any;10>> be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
contract negligence or other tortious action arising out of or in connection with the use or performance of this
software
"""

_ZLIB = """
this software is provided as is without any express or implied warranty in no event will <<any;10>> be held liable for
any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
including commercial applications and to alter it and redistribute it freely subject to the following restrictions
<<any;1>> the origin of this software must not be misrepresented you must not claim that you wrote the original
software if you use this software in a product an acknowledgment <<any;12>> in the product documentation would be
appreciated but is not required <<any;1>> altered source versions must be plainly marked as such and must not be
misrepresented as being the original software <<any;1>> this notice may not be removed or altered from any source
distribution
"""

_BOOST = """
permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license the software to use reproduce display distribute execute and
transmit the software and to prepare derivative works of the software and to permit third parties to whom the software
is furnished to do so all subject to the following the copyright notices in the software and this entire statement
including the above license grant this restriction and the following disclaimer must be included in all copies of the
software in whole or in part and all derivative works of the software unless such copies or derivative works are solely
in the form of machine executable object code generated by a source language processor the software is provided as is
without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness
for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the
software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software
"""

_UNLICENSE = """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial
or non commercial and by any means
"""

_APACHE_HEADER = """
licensed under the apache license version 2.0 the license you may not use <<any;6>> except in compliance with the
license <<opt>>you may obtain a copy of the license at <<any;12>><</opt>> unless required by applicable law or agreed to
in writing software distributed under the license is distributed on an as is basis without warranties or conditions of
any kind either express or implied
"""

_GPL_HEADER = """
<<any;6>> free software you can redistribute it and or modify it under the terms of the gnu general public license as
published by the free software foundation <<opt>>either<</opt>> version <<any;12>> any later version
"""

_LGPL_HEADER = """
free software you can redistribute it and or modify it under the terms of the gnu <<any;1>> general public license as
published by the free software foundation <<opt>>either<</opt>> version <<any;12>> any later version <<any;60>> without
even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public
license for more details
"""

_MPL_HEADER = """
this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not
distributed with this file you can obtain one at <<any;6>> mozilla org mpl 2.0
"""

TEMPLATES: list[tuple[str, str]] = [
    ("mit-reference", "<<opt>>this work is<</opt>> released under the <<opt>>terms of the<</opt>> mit license"),
    ("mit-reference", "licensed under the <<opt>>terms of the<</opt>> mit license"),
    ("apache-2.0-reference", "licensed under the apache license <<opt>>version<</opt>> 2.0"),
    (
        "gpl-3.0-reference",
        "licensed under the <<opt>>terms of the<</opt>> gnu general public license "
        "<<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version 3",
    ),
    (
        "gpl-2.0-reference",
        "licensed under the <<opt>>terms of the<</opt>> gnu general public license "
        "<<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version 2",
    ),
    ("mit-text", _MIT),
    ("bsd-2-clause", _BSD_GRANT + _BSD_DISCLAIMER),
    ("bsd-3-clause", _BSD_GRANT + _BSD_ENDORSEMENT + _BSD_DISCLAIMER),
    ("isc-text", _ISC),
    ("zlib-text", _ZLIB),
    ("bsl-1.0", _BOOST),
    ("unlicense", _UNLICENSE),
    ("apache-2.0-header", _APACHE_HEADER),
    ("gpl-header", _GPL_HEADER),
    ("lgpl-header", _LGPL_HEADER),
    ("mpl-2.0-header", _MPL_HEADER),
]
