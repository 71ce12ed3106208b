"""Wordings of licences and of the notices that grant them, as templates of ``licenses``.

``[[...]]`` is optional, ``<<name:n>>`` stands for up to n words of any kind, ``{{a|b}}`` for
one of the words; all else is mandatory. A template begins with a mandatory word.
"""

# ---- fixed values: the licences' own published wording -----------------------------------------

_MIT = """
permission is hereby granted, free of charge, to any person obtaining a copy of this <<material:6>> and associated documentation files
(the "<<name:4>>"), to deal in the <<name:4>> without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the <<name:4>>, and to permit persons to whom the <<name:4>> is furnished to do so,
subject to the following conditions:
the above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the <<name:4>>.
"""

_ISC = """
permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.
"""

_BSD_2 = """
redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
[[1.]] redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
[[2.]] redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""

_BSD_3 = (
    _BSD_2
    + """
[[3.]] neither the name of <<owner:12>> nor the names of {{its|their}} <<contributors:3>> may be used to endorse or promote products derived from this
software without specific prior written permission.
"""
)

_APACHE_NOTICE = """
licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<material:4>> except in compliance with the License.
you may obtain a copy of the License at
"""

_GPL_NOTICE = """
this <<material:4>> is free software: you can redistribute it and/or modify it under the terms of the GNU <<kind:2>> General Public License as published by
the Free Software Foundation, either version VERSION of the License, or (at your option) any later version.
"""

_GRANT = "{{licensed|released|distributed|available}} under [[the terms of]] "
_CC = _GRANT + "[[the]] [[a]] [[creative commons]] [[cc]] {{by|attribution}} "

#: Name and wording. A short grant is named ``-grant``, a whole wording or notice ``-text``.
TEMPLATES = [
    ("mit-text", _MIT),
    ("mit-grant", _GRANT + "the MIT license"),
    ("isc-text", _ISC),
    ("bsd-2-clause-text", _BSD_2),
    ("bsd-3-clause-text", _BSD_3),
    ("bsd-grant", _GRANT + "[[a]] [[the]] [[{{new|modified|simplified}}]] [[{{2|3}} clause]] BSD license"),
    ("apache-2.0-text", _APACHE_NOTICE),
    ("apache-2.0-grant", _GRANT + "the Apache license, [[version]] 2.0"),
    ("gpl-2.0-text", _GPL_NOTICE.replace("VERSION", "2")),
    ("gpl-3.0-text", _GPL_NOTICE.replace("VERSION", "3")),
    ("gpl-2.0-grant", _GRANT + "the [[GNU]] General Public License, [[{{version|v}}]] 2"),
    ("gpl-3.0-grant", _GRANT + "the [[GNU]] General Public License, [[{{version|v}}]] 3"),
    ("cc-by-4.0-grant", _CC + "4.0"),
    ("cc-by-sa-4.0-grant", _CC + "{{sa|sharealike}} 4.0"),
    ("cc-by-nc-4.0-grant", _CC + "{{nc|noncommercial}} 4.0"),
]

#: The phrases that every text is searched for, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
