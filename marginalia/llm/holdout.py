"""A hand-checked holdout for problem 6: texts read and labelled by hand, used only to calibrate."""

HOLDOUT = [
    ("The second half of the novel is slower, and I liked it better for that.", "prose"),
    ("I read this on the train and missed my stop.", "prose"),
    ("Why did she keep the letter? I kept turning the page to find out, and the author never tells us.", "prose"),
    ("NOBODY WARNED ME THAT THE DOG DIES. I WAS NOT READY FOR THAT AT ALL.", "prose"),
    ("honestly i think the father knew all along and just could not say it to anyone in the house", "prose"),
    ("Ich habe das Buch in einer Nacht gelesen und konnte danach nicht schlafen.", "prose"),
    ("Mir gefiel vor allem, wie ruhig die Autorin vom Abschied erzählt.", "prose"),
    ("Je ne sais pas pourquoi cette page me fait pleurer, mais elle le fait chaque fois.", "prose"),
    ("La última escena me dejó pensando en mi padre durante varios días.", "prose"),
    ("Não gostei do final, mas entendo por que ele foi embora sem dizer nada.", "prose"),
    ("Ik vond het einde mooi, al had ik graag geweten wat er met de broer gebeurde.", "prose"),
    ("The chapter is short.\nIt ends with a door.\nI have read it\nfour times now and I still\ndo not know who is behind it.", "prose"),
    ("Three things stayed with me:\n- the lamp\n- the boat\nBut most of all I remember how the aunt laughs when nobody else dares to.", "prose"),
    ("It isn�t a love story, it�s a story about waiting, and the waiting is the point.", "prose"),
    ("“Leave it,” he says, and she leaves it. That is the whole marriage in one line.", "prose"),
    ("Page 212, second paragraph: this is where I stopped liking him and started to understand him.", "prose"),
    ("so good", "prose"),
    ("I agree with the last comment, the map on page 3 gives the ending away!!!", "prose"),
    ("She paid 12 € for the coat in 1938 and wears it in every scene until the war ends.", "prose"),
    ("Der Brief, die Uhr, das Fenster: alles kehrt am Ende wieder, und keiner merkt es.", "prose"),
    ("- lamp\n- boat\n- aunt\n- marriage\n- letter and coat\n- window in the hall", "list"),
    ("1. The lamp\n2. The boat\n3. The aunt (ch. 4)\n4. The marriage\n5. The coat", "list"),
    ("lamp, boat, aunt, coat and window, marriage (ch. 3), door in the hall, map / letter, uncle, dog, bread", "list"),
    ("a) lamp in the boat; b) aunt; c) coat / window; d) Anna Berger; e) map (ch. 12); f) uncle and dog", "list"),
    ("[ ] buy lamp\n[x] boat\n[ ] aunt and uncle\n[ ] coat (ch. 2)\n[x] map", "list"),
    ("milk\neggs\nbread\ntea\nlamp oil\nstring", "list"),
    ("name,page,object\nAnna Berger,12,lamp\nOtto Lenz,44,coat\nAnna Berger,90,map", "table"),
    ("| name | page |\n| --- | --- |\n| Anna | 12 |\n| Otto | 44 |\n| Marta | 71 |", "table"),
    ("Anna\t12\tlamp\t7.1\nOtto\t44\tcoat\t6.0\nMarta\t71\tmap\t9.3", "table"),
    ("Anna Berger          12   lamp     7.1\nOtto Lenz            44   coat     6.0\nMarta Kroll          71   map      9.3", "table"),
    ("\"Anna Berger\";\"12\";\"lamp\"\n\"Otto Lenz\";\"44\";\"coat\"\n\"Marta Kroll\";\"71\";\"map\"", "table"),
    ("aaaaaaaaaaaaaaaaaaaa hhhhhhhhhhhhhhhhhhhhhhhhhh !!!!!!!!!!!!", "junk"),
    ("kJ8fD2mQx9LpZ0aVbT7eWnRy4uIoPqSdFgHjKlMzXcVbNm1234567890QwErTyUiOp", "junk"),
    ("#^*|^ ~*\\<\\%|%-_+<>~ \\^~#% +%~#&%^\\>-%~#", "junk"),
    ("12.331 88.120 45.001 7.25 100.332 56.7 81.904 33.12", "junk"),
    ("Home | Log in | Books | Next >> | Page 3 of 9 | Share | Accept cookies", "junk"),
    ("<div class=\"a\"><span>lamp</span></div><div class=\"b\"><span>&nbsp;</span></div>", "junk"),
    ("[10:22:31] INFO lamp.boat rc=0\n[10:22:35] WARN coat.map rc=3", "junk"),
    ("xq zrtp wlk bnmv qqwx plok trz vbn hgf dsx klop", "junk"),
    ("lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp lamp", "junk"),
]
