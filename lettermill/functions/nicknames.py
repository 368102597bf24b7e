"""Short forms of given names, from general knowledge: formal name, then its short forms."""

# Fixed values.
SHORT_FORMS = """
abigail abby abbie gail
alexander alex sandy
andrew andy drew
anthony tony
benjamin ben benny
catherine cathy cate
charles charlie chuck chas
christopher chris
daniel dan danny
deborah debbie deb debby
dorothy dot dottie dolly
edward ed eddie
elizabeth liz beth betty eliza lizzie betsy
eugene gene
frank frankie
frederick fred freddie freddy
gregory greg
jacqueline jackie
james jim jimmy jamie
jennifer jen jenny jenn
john johnny jack
joseph joe joey
katherine kate kathy katie kat
kenneth ken kenny
lawrence larry
leticia letty tish
margaret peggy maggie meg marge
mark marc
matthew matt
michael mike mick mickey
nathaniel nate nat nathan
nicholas nick
pamela pam
patricia pat patty trish
peter pete
quentin quent
rebecca becky becca
richard rick dick rich richie
robert bob rob bobby robbie
ronald ron ronnie
rosemary rosie
samuel sam
stephanie steph steffi
stephen steve
susan sue suzie susie
theodore ted theo teddy
thomas tom tommy
timothy tim timmy
victoria vicky vicki tori
viola vi
william bill will billy
zachary zach zack zac
"""

GROUPS: list[list[str]] = [line.split() for line in SHORT_FORMS.strip().splitlines()]
FORMAL: dict[str, str] = {short: g[0] for g in GROUPS for short in g[1:]}
SHORTS: dict[str, list[str]] = {g[0]: g[1:] for g in GROUPS}
