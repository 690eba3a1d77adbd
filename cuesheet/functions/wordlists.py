"""Fixed word lists."""

# The widely used 179-word English stop list.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain
aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# The intensity word list that scores must agree on.
INTENSITY_WORDS = """
never always hate love kill die forever everything nothing ever must
desperate alone eternal furious angry screaming crying terrified panicked
shocked disgusted crazy mad obsessed destroy ruin wreck obliterate eliminate
banish curse damn blast explode burst bleed burn fire slap stab choke
punch hurt pain suffer injured broken shatter fracture collapse torture
abuse suffocate smash intense urgent critical severe extreme maximum absolute
total complete utter insane mental frantic hysterical paranoid nervous worried
afraid scared fear coward brave hero legend icon epic myth immortal
doomed fate destiny inevitable unavoidable undeniable unforgettable fatal deadly
murder suicide execution justice revenge vengeance retaliation payback honor
betrayal traitor monster demon devil angel god holy sacred damnation
salvation heaven hell blessing miracle magic witch warlock wizard
beast creature darkness shadow light bright glow shine blinding silent
screech howl roar growl echo bang boom crash scream yell yelp
shriek gasp moan groan sob weep flood tsunami earthquake eruption chaos
anarchy riot uprising disaster catastrophe meltdown pandemic outbreak plague
infestation infection toxicity radiation explosion war battle fight conflict
clash ambush raid attack siege massacre slaughter genocide holocaust
beheading hanging lynching bombing airstrike grenade missile nuke nuclear
atomic chemical weapon gun knife blade dagger blood gore bones skull
corpse grave funeral coffin omen prophecy ritual sacrifice
""".split()

# English pronouns, a closed word class.
PRONOUNS = """
i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves who whom whose which what this that these those someone
somebody something anyone anybody anything everyone everybody everything nobody nothing one
""".split()
